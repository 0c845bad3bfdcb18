"""Operators on small literal tables: absence, ties, refusals and round trips."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mergewright.functions import text
from mergewright.operators import compare, explore, latest, learn, match, merge
from mergewright.operators.predicates import Condition, Field, compile_condition, compile_filter
from mergewright.sources import readers
from mergewright.streaming import refresh


def one(df):
    return [tuple(r) for r in df.collect()]


def test_unknown_fields_and_operators_are_refused(spark):
    with pytest.raises(ValueError, match="unknown field"):
        compile_filter([Condition("x'; DROP", "equals", ("1",))], {"a": Field("a")})
    with pytest.raises(ValueError, match="unknown operator"):
        compile_filter([Condition("a", "like", ("1",))], {"a": Field("a")})


def test_conditions(spark):
    df = spark.createDataFrame([("a%b", "7"), ("axb", "x"), (None, None), ("", "-3")], "t string, n string")
    fields = {"t": Field("t"), "n": Field("n", "number_text")}
    hits = lambda *c: sorted((r.t or "" for r in df.where(compile_condition(Condition(*c), fields)).collect()))
    assert hits("t", "contains", ("%",)) == ["a%b"]
    assert hits("t", "not_equals", ("axb",)) == ["", "", "a%b"]
    assert hits("t", "is_empty") == ["", ""]
    assert hits("n", "gte", ("0",)) == ["a%b"]
    assert hits("n", "lte", ("0", "nonsense")) == [""]
    assert hits("n", "equals", ("nonsense",)) == []
    assert len(hits("n", "not_equals", ("nonsense",))) == 4


def test_cleaners(spark):
    df = spark.createDataFrame([(" x ",), ("",), ("-",), ("Unknown",), (None,), ("0",), ("12",)], "v string")
    got = one(df.select(text.cleaned(F.col("v")), text.measure(F.col("v"))))
    assert got == [("x", None), (None, None), (None, None), (None, None), (None, None), ("0", None), ("12", 12)]
    dates = spark.createDataFrame([("20240229",), ("20230229",), ("202402",), ("2024",), ("x",), (None,)], "v string")
    got = one(dates.select(text.partial_date(F.col("v")).alias("d")).select("d.value", "d.precision"))
    assert got == [(dt.date(2024, 2, 29), "day"), (None, None), (dt.date(2024, 2, 29), "month"), (dt.date(2024, 12, 31), "year"), (None, None), (None, None)]
    assert one(spark.range(1).select(text.scaled(F.lit("133.5"), "1", 0)))[0][0] == 134


@given(st.text("ab", max_size=6), st.text("ab", max_size=6))
@settings(max_examples=60, deadline=None)
def test_osa_is_symmetric_and_bounded(a, b):
    d, back = text.osa_distances([a, b], [b, a]).tolist()
    assert d == back and abs(len(a) - len(b)) <= d <= max(len(a), len(b)) and (d == 0) == (a == b)


def test_osa_swap(spark):
    assert text.osa_distances(["ab", "ca"], ["ba", "abc"]).tolist() == [1, 3]
    assert one(spark.range(1).select(text.folded(F.lit("Citroën")), text.phonetic(F.lit("Volkswagen")), text.phonetic(F.lit("VW"))))[0][0] == "CITROEN"


def test_merge_ranks_dates_and_retraction(spark):
    day = dt.date
    rows = [(1, "f", "a", "rule", day(2024, 1, 1)), (1, "f", "b", "provider", day(2023, 1, 1)), (1, "f", "c", "provider", day(2023, 5, 1)), (2, "f", "z", "unknown", day(2020, 1, 1))]
    obs = spark.createDataFrame(rows, "entity int, field string, value string, source string, observed_on date")
    ranks = {"rule": 20, "provider": 50}
    got = {r.entity: (r.value, r.alternatives) for r in merge.survivors(obs, ranks).collect()}
    assert got == {1: ("c", ["a", "b"]), 2: ("z", [])}
    back = merge.survivors(merge.retract(obs, spark.createDataFrame([(1, "f", "provider")], "entity int, field string, source string")), ranks)
    assert {r.entity: r.value for r in back.collect()} == {1: "a", 2: "z"}
    assert {r.entity: r.value for r in merge.survivors(obs.repartition(7), ranks).collect()} == {1: "c", 2: "z"}


def test_upsert_protects_columns_and_reports(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, "z")], "k int, v string, p string")
    new = spark.createDataFrame([(2, "b", "other"), (3, "c", "other"), (4, "d", "w")], "k int, v string, p string")
    got = sorted(one(merge.upsert(old, new, "k", protected=["p"])))
    assert got == [(1, "a", "x", "unchanged"), (2, "b", "y", "unchanged"), (3, "c", "z", "updated"), (4, "d", "w", "inserted")]


def test_rules_learn_apply_idempotent(spark):
    rows = [("m", "E1")] * 4 + [("m", None), ("n", "A"), ("n", "B"), (None, "C")]
    df = spark.createDataFrame(rows, "k string, t string")
    rules = learn.majority_rules(df, ["k"], "t", "T", support=3, agreement=0.9)
    assert [(r.k, r.value, r.support) for r in rules.collect()] == [("m", "E1", 4)]
    filled = learn.apply_rules(df, rules, ["k"], "t")
    assert filled.where("k = 'm' AND t = 'E1'").count() == 5 and filled.where("filled_by IS NOT NULL").count() == 1
    again = learn.apply_rules(filled.drop("filled_by"), rules, ["k"], "t")
    assert again.where("filled_by IS NOT NULL").count() == 0
    assert one(learn.reconcile(rules, rules))[0][1] == "kept"


def test_intervals_and_seek(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    df = spark.createDataFrame([("p", t(1), 1, "a"), ("p", t(2), 2, "a"), ("p", t(3), 3, "b")], "k string, s timestamp, i int, v string")
    got = sorted(one(latest.intervals(df, "k", "s", "i", "v")))
    assert got == [("p", "a", t(1), t(3), False), ("p", "b", t(3), None, True)]
    right = spark.createDataFrame([("p", t(2), 9)], "k string, r timestamp, x int")
    assert sorted((r.i, r.x) for r in latest.seek(df, right, ["k"], "s", "r", ["x"]).collect()) == [(1, 9), (2, 9), (3, None)]


def test_fingerprint_adds_up(spark):
    df = spark.range(100).withColumn("v", F.when(F.col("id") % 3 > 0, F.col("id")))
    whole = one(latest.fingerprint(df, ["id", "v"]))[0]
    parts = [one(latest.fingerprint(df.where(f"id % 2 = {i}"), ["id", "v"]))[0] for i in (0, 1)]
    assert whole[1:] == tuple(str(int(a) + int(b)) for a, b in zip(*(p[1:] for p in parts), strict=True))
    assert one(latest.fingerprint(df.repartition(5), ["id", "v"]))[0] == whole


def test_blocking_takes_the_first_level_only(spark):
    q = spark.createDataFrame([(1, "VOLVO"), (2, "VOLV0"), (3, "NONE")], "q int, a string")
    c = spark.createDataFrame([(10, "VOLVO"), (11, "VOLVA")], "c int, b string")
    levels = [(F.col("a"), F.col("b")), (F.substring("a", 1, 4), F.substring("b", 1, 4))]
    assert sorted((r.q, r.c, r.block_level) for r in match.block(q, c, levels).collect()) == [(1, 10, 0), (2, 10, 1), (2, 11, 1)]


def test_components_over_shared_tokens(spark):
    from mergewright.sources.shared import stored

    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (9, "z")] + [(n, f"c{n // 2}") for n in range(20, 60)] + [(n, f"d{(n + 1) // 2}") for n in range(20, 60)], "n int, t string")
    got = {r.n: r.component for r in compare.leakage_components(df, "n", "t", stored).collect()}
    assert got[1] == got[2] == got[3] == 1 and got[9] == 9 and all(got[n] == 20 for n in range(20, 60))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "a string, b string")
    assert explore.shapes(empty, "a", "exact").count() == 0
    assert one(explore.counters(empty, {"n": F.lit(True)})) == [(0,)]
    assert learn.majority_rules(empty, ["a"], "b", "X").count() == 0


def test_fixed_width_file_round_trip(spark, tmp_path):
    layout = {"mark": (0, 2), "name": (2, 6), "year": (9, 4)}
    rows = spark.createDataFrame([("AB", "Ängel", "2024"), ("AB", None, "1999"), ("XX", "bad", "1")], "mark string, name string, year string")
    path = tmp_path / "f.txt"
    lines = [r[0] for r in rows.select(readers.to_fixed_width(rows, layout, 14)).collect()] + ["short"]
    path.write_bytes("\r\n".join(lines).encode("latin-1"))
    got = one(readers.read_fixed_width(spark, str(path), layout, 14, (0, "AB")))
    assert got == [("AB", "Ängel", "2024", None), ("AB", None, "1999", None), (None, None, None, "marker"), (None, None, None, "length")]


def test_xml_entities(spark, tmp_path):
    (tmp_path / "x.xml").write_text('<r><Entity ID="1"><Value AttributeID="n">Anna</Value><Value AttributeID="p"> </Value></Entity><Entity ID="2"><Value AttributeID="p">7</Value><Value AttributeID="q">8</Value></Entity></r>')
    got = sorted(one(readers.read_entities(spark, str(tmp_path / "x.xml"), "Entity", {"n": "name", "p": "phone"})))
    assert got == [("1", "Anna", None), ("2", None, "7")]


def test_landing_needs_equal_counts(spark, tmp_path):
    path = (tmp_path / "t").as_uri()
    assert readers.land(spark.range(5), path, 5) == 5
    with pytest.raises(ValueError, match="declared"):
        readers.land(spark.range(5), path, 6)
    assert readers.landed(spark, path).count() == 5


def test_streaming_upsert_and_windows(spark, tmp_path):
    versions, inbox = tmp_path / "v", tmp_path / "in"
    path_of = lambda n: (versions / str(n)).as_uri()
    spark.createDataFrame([(1, "a")], "k int, v string").write.parquet(path_of(0))
    spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string").coalesce(1).write.parquet(inbox.as_uri())
    refresh.read_stream(spark, inbox.as_uri()).writeStream.foreachBatch(refresh.upsert_into(path_of, "k")).option("checkpointLocation", (tmp_path / "c").as_uri()).trigger(availableNow=True).start().awaitTermination()
    assert sorted(one(spark.read.parquet(path_of(1)))) == [(1, "b"), (2, "c")]
    t = dt.datetime(2024, 1, 1, 10)
    events = tmp_path / "e"
    spark.createDataFrame([(1, t), (1, t), (2, t)], "k int, at timestamp").write.parquet(events.as_uri())
    stream = refresh.deduplicated(refresh.read_stream(spark, events.as_uri()), ["k"], "at", "1 hour")
    stream.writeStream.format("memory").queryName("dedup").option("checkpointLocation", (tmp_path / "c2").as_uri()).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("dedup").count() == 2


def test_token_pairs_take_short_and_frequent_words(spark):
    rows = [(i, "the a of to " + " ".join(f"w{i}x{j}" for j in range(30))) for i in range(20)]
    rows += [(100, "so we had it all by the end"), (101, "Had it; all so"), (102, None), (103, "")]
    items = [(1, "so we had it all"), (2, "the a of to"), (3, "nothing here"), (4, ""), (5, None)]
    got = {(r.d, r.i): (r.shared_words, r.item_words, r.jaccard) for r in match.token_pairs(spark.createDataFrame(rows, "d int, t string"), "d", spark.createDataFrame(items, "i int, t string"), "i", "t").collect()}
    want = {(i, 2): (4, 4, round(4 / 34, 6)) for i in range(20)}
    assert got == want | {(100, 1): (5, 5, 0.625), (101, 1): (4, 5, 0.8)}


def test_candidates_of_unlike_names_count(spark, tmp_path):
    """Every catalogue row of a query's brand is its candidate, however little the names are alike; parts alike have them each."""
    import __spark_entry__ as entry

    rows = [(2, "blue ring", "B1", "SMALL", 5), (14, "blue ring", "B1", "SMALL", 5), (3, "zxq", "B1", "SMALL", 5), (4, "blue ring", "B2", None, 5)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r.q_id, r.c_id): (r.rank, r.n_candidates) for r in entry.queries()["candidate_scoring_topk"](spark, str(tmp_path)).collect()}
    assert got == {(2, 2): (1, 2), (2, 3): (2, 2), (14, 2): (1, 2), (14, 3): (2, 2), (3, 3): (1, 2), (3, 2): (2, 2), (4, 4): (1, 1)}
    pairs = {(r.q_id, r.c_id) for r in entry.queries()["two_pass_rescoring"](spark, str(tmp_path)).collect()}
    assert pairs == {*got}
