"""What must not grow with a table: data through the driver, files read by one task, passes over the same rows."""

from mergewright.operators import compare, match, matcher, vocabulary
from mergewright.plans import files
from mergewright.sources.shared import stored
from pyspark.sql import functions as F

from test_evidence import RECORD, TYPE


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_components_broadcast_nothing(spark):
    plans = []

    def store(df):
        plans.append(plan(df))
        return stored(df)

    rows = [(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c")]
    got = compare.leakage_components(spark.createDataFrame(rows, "n long, t string"), "n", "t", store)
    assert {tuple(r) for r in got.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    assert plans and not any("Broadcast" in p for p in plans)


def test_proposals_broadcast_nothing(spark):
    known = spark.range(6).select(F.lit("x").alias("k"), F.lit("v").alias("value"))
    out = compare.projected_proposals(known, spark.range(2).select("id", F.lit("x").alias("k")), "id", [["k"]], "value")
    assert {tuple(r) for r in out.collect()} == {(0, "v", 0, 6), (1, "v", 0, 6)}
    assert "Broadcast" not in plan(out)


def test_named_reads_hits_once(spark):
    rows = [(1, 0, "A B", "x"), (1, 3, "C D", "x"), (1, 5, "C D", "y"), (1, 60, "LONG TERM", "z"), (2, 70, "A B", None)]
    hits = spark.createDataFrame(rows, "d long, place int, term string, target string")
    out = vocabulary.named(hits, "d", F.col("place") < 50)
    assert {tuple(r) for r in out.collect()} == {(1, "A B", 0, None, 2, 1, 4), (2, "A B", 70, None, 0, 0, 1)}
    assert plan(out).split("Initial Plan")[0].count("Scan ExistingRDD") == 1


def test_entities_lie_in_small_files(spark, tmp_path, monkeypatch):
    spark.range(50).selectExpr("id AS c_custkey", "concat('n', id) AS c_name", "1.5 AS c_acctbal", "'S' AS c_mktsegment", "3 AS c_nationkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(files, "FILE_ENTITIES", 10, raising=False)
    monkeypatch.setattr(files, "shared_path", lambda s, name: f"{tmp_path}/{name}")
    import __spark_entry__ as entry

    assert entry.queries()["entity_file"](spark, str(tmp_path)).count() == 50
    assert len(list((tmp_path / "entities").glob("part-*"))) == 5


def test_rows_become_words_once(spark):
    rows, items = spark.createDataFrame([(1, "a b c")], "d long, t string"), spark.createDataFrame([(7, "a b")], "i long, t string")
    out = match.token_pairs(rows, "d", items, "i", "t")
    assert [tuple(r) for r in out.collect()] == [(1, 7, 2, 2, 0.666667)]
    assert plan(out).split("Initial Plan")[0].count("Scan ExistingRDD") == 1


def test_words_of_a_text_are_made_once(spark):
    rows = spark.createDataFrame([(1, "a b")], "d long, t string").select("d", F.concat(F.lit("only here "), "t").alias("t"))
    out = vocabulary.read_terms(rows, "d", "t", spark.createDataFrame([("a b", "x")], "w string, g string"), "w", "g")
    assert [tuple(r) for r in out.collect()] == [(1, 2, 2, "A B", "x")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("only here") == 1


def test_evidence_of_a_pair_is_made_once(spark):
    rows = [(1, "VOLVO", "XC 60", 2010, None, ["DIESEL"], None, 2400, 150, "AWD", "SUV", None)]
    types = spark.createDataFrame([(i, "VOLVO", "XC 60", 2008, 2017, None, None, ["DIESEL"], None, None, 2400, 150 + i, "AWD", ["SUV"], None, None) for i in (0, 1)], TYPE)
    records, labels = spark.createDataFrame(rows, RECORD), types.select("c_id", F.col("c_model").alias("label"))
    out = matcher.decided(matcher.scored(records, types, labels), records)
    fields = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        made = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", fields)
    assert made.count("fuels_variant_not_confirmed") == 1
    assert [(r.top_reference, r.n_candidates) for r in out.collect()] == [(0, 2)]
