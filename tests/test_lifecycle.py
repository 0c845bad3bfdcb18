"""Rules, reviews, corrections and versions over time, hierarchies, vocabularies and cascades on odd rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from mergewright.operators import cascade, classify, compare, hierarchy, lifecycle, summaries, vocabulary
from mergewright.operators.predicates import Condition, Field, compile_filter


def test_rules_and_versions_tell_nulls_apart(spark):
    df = lambda rows: spark.createDataFrame(rows, "a string, b string, c string")
    kept = {(r.a, r.b, r.c): r.verdict for r in lifecycle.reconcile(df([(None, "x", "y"), (None, "x", "y"), ("p|q", "r", "")]), df([(None, "x", "y"), ("p", "q|r", ""), ("p|q", "r", None)]), ["a", "b", "c"]).collect()}
    assert kept == {(None, "x", "y"): "keep", ("p|q", "r", ""): "retire", ("p", "q|r", ""): "add", ("p|q", "r", None): "add"}
    v = lambda *row: df([row]).withColumn("v", F.lit("1"))
    assert lifecycle.sealed(v(None, "a|b", "c"), v("", "a", "b|c"), "v", ["a", "b", "c"]).first().verdict == "conflict"
    assert lifecycle.sealed(v(None, "a|b", "c"), v(None, "a|b", "c"), "v", ["a", "b", "c"]).first().verdict == "replay"
    none = df([]).withColumn("v", F.lit("1"))
    assert lifecycle.sealed(none, v("a", "b", "c"), "v", ["a"]).first().verdict == "sealed" and lifecycle.sealed(v("a", "b", "c"), none, "v", ["a"]).count() == 0


def test_reviews_move_and_queue_once(spark):
    moves = [("pending", "in_review", "moved"), ("pending", "resolved", "moved"), ("pending", "rejected", "moved"), ("in_review", "pending", "moved"), ("in_review", "rejected", "moved"), ("resolved", "pending", "refused"), ("rejected", "pending", "refused"), ("pending", "pending", "unchanged"), (None, "pending", "missing")]
    items = spark.createDataFrame([(i, a) for i, (a, _, _) in enumerate(moves) if a], "k int, state string")
    asked = spark.createDataFrame([(i, b) for i, (_, b, _) in enumerate(moves)], "k int, to_state string")
    assert [r.verdict for r in lifecycle.transitions(items, asked, "k").orderBy("k").collect()] == [v for _, _, v in moves]
    queue = spark.createDataFrame([("a", "resolved"), (None, "pending")], "k string, state string")
    found = spark.createDataFrame([("a",), (None,), ("b",), ("b",), ("",)], "k string")
    assert sorted((str(r.k), r.state) for r in lifecycle.enqueue(queue, found, ["k"]).collect()) == [("", "pending"), ("None", "pending"), ("a", "resolved"), ("b", "pending")]


def test_fold_in_time(spark):
    def fold(*rows):
        df = spark.createDataFrame([("e", "f", v, s, date(2020, m, 1) if m else None, c) for v, s, m, c in rows], "entity string, field string, value string, source string, observed_on date, cleared boolean")
        return [(r.value, r.source, r.since and r.since.month, r.n_alternatives) for r in lifecycle.fold_in_time(df, {"review": 3, "ts": 2, "ais": 2}).collect()]

    # A value said again after another one and a clear is new from then on.
    assert fold(("x", "ts", 1, False), ("y", "ts", 2, False), (None, "ts", 7, True), ("x", "ts", 8, False)) == [("x", "ts", 8, 0)]
    # A confirmation keeps source and day; a lower rank is kept beside.
    assert fold(("x", "ts", 1, False), ("x", "ais", 5, False)) == [("x", "ts", 1, 0)]
    assert fold(("x", "review", 1, False), ("y", "ais", 5, False)) == [("x", "review", 1, 1)]
    # Silence lets the alternative speak, then empties the field.
    assert fold(("x", "ts", 1, False), ("y", "ais", 5, False), (None, "ais", 6, False)) == [("x", "ts", 1, 0)]
    assert fold(("x", "ts", 1, False), (None, "ts", 6, False), (None, "ts", 6, None)) == [(None, None, None, 0)]
    # Equal rank and day keep what is there; a later day wins; a null day is the earliest.
    assert fold(("x", "ais", 2, False), ("y", "ts", 2, False)) == [("x", "ais", 2, 1)]
    assert fold(("y", "ts", None, False), ("x", "ais", 2, False)) == [("x", "ais", 2, 1)]
    assert fold() == []


def test_corrections_give_back_what_they_took(spark):
    merged = spark.createDataFrame([(e, "f", "now", "correction") for e in ("set", "took", "kept", "none")], "entity string, field string, value string, source string")
    made = spark.createDataFrame([("set", "f", "set", "new", 1), ("took", "f", "set", "now", 1), ("took", "f", "withdraw", None, 2), ("kept", "f", "ignore", None, 1), ("kept", "f", "ignore", None, 2)], "entity string, field string, action string, value string, position int")
    other = spark.createDataFrame([("took", "f", "back", "ts")], "entity string, field string, value string, source string")
    got = {r.entity: (r.value, r.source) for r in lifecycle.project_corrections(merged, made, other).collect()}
    assert got == {"set": ("new", "correction"), "took": ("back", "ts"), "kept": ("now", "correction"), "none": ("now", "correction")}


def test_hierarchy_by_ids(spark):
    top = spark.createDataFrame([(1, "A"), (2, "A")], "t int, t_name string")
    middle = spark.createDataFrame([(10, 1, "M", False), (11, 2, "M", None), (12, 9, "lost", False), (13, 1, "gone", True), (14, None, "none", False)], "m int, t int, m_name string, deleted boolean")
    leaves = spark.createDataFrame([(10,), (10,), (11,), (13,), (99,), (None,)], "m int")
    levels = [(top, "t", None, "t_name"), (middle, "m", "t", "m_name")]
    got = {(r.t, r.m, r.t_name, r.m_name, r.n_leaves, r.missing) for r in hierarchy.assembled(levels, leaves, "deleted").collect()}
    assert got == {(1, 10, "A", "M", 2, False), (2, 11, "A", "M", 1, False), (9, 12, None, "lost", 0, True), (None, 14, None, "none", 0, True), (None, 99, None, None, 1, True), (None, None, None, None, 1, True)}
    with pytest.raises(Exception, match="missing reference"):
        hierarchy.assembled(levels, leaves, "deleted", strict=True).collect()
    assert hierarchy.assembled([(x.limit(0), *r) for x, *r in levels], leaves.limit(0)).count() == 0


def test_seeks(spark):
    for keys in ([5], [5, 6], [-3, 0, 7, 7, 40, None], list(range(0, 1000, 7)), [-(2**62), 2**62]):
        rows = sorted(k for k in keys if k is not None)
        got = sorted(tuple(r) for r in hierarchy.seek_sample(spark.createDataFrame([(k,) for k in keys], "k long"), "k", 10).collect())
        seeks = [rows[0] + (rows[-1] - rows[0]) * i // 10 for i in range(10)]
        assert got == sorted((s, min(k for k in rows if k >= s)) for s in seeks)
    assert hierarchy.seek_sample(spark.createDataFrame([], "k long"), "k", 10).count() == 0


def test_numbers_in_text(spark):
    rows = [("model 2.", 2, True), ("2, 3", 2, True), ("2.0", 2, False), ("1,6 fsi", 6, False), ("a2b", 2, True), ("22", 2, False), ("1.2.3", 2, False), ("", 2, False), (None, 2, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, n int, want boolean")
    assert [r.h for r in df.select("i", classify.holds_number(F.col("t"), F.col("n")).alias("h")).orderBy("i").collect()] == [w for _, _, w in rows]
    pairs = [("a3 5", "5 3 3", "conflict"), ("a3 5", "b3-5", "equal"), ("a", "5", "none"), (None, "5", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(pairs)], "i int, a string, b string, want string")
    assert [r.s for r in df.select("i", classify.series_relation(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()][:3] == [w for _, _, w in pairs][:3]


def test_filters_compare_exactly_and_refuse(spark):
    df = spark.createDataFrame([("9007199254740992",), ("9007199254740993",), ("0.1",), ("x",), (None,), ("1e3",)], "t string")
    one = lambda op, *v: [r.t for r in df.where(compile_filter([Condition("t", op, v)], {"t": Field("t", "number_text")})).collect()]
    assert one("equals", 9007199254740993) == ["9007199254740993"] and one("gte", "9007199254740993") == ["9007199254740993"]
    assert one("equals", "0.10") == ["0.1"] and one("between", 0, 1) == ["0.1"] and one("equals", "x") == []
    for bad in (Condition("t", "between", (1,)), Condition("d", "gte", ("1996-02-30",)), Condition("d", "between", ("1996-02-01",)), Condition("d", "equals", ("soon",))):
        with pytest.raises(ValueError):
            compile_filter([bad], {"t": Field("t", "number_text"), "d": Field("d", "date")})


def test_terms_keep_numbers_whole(spark):
    docs = spark.createDataFrame([(1, "A model 2.0 of the 1.6 fsi, model 2"), (2, None), (3, ""), (4, "Model 2 ~ model-2"), (5, "model")], "id int, text string")
    terms = spark.createDataFrame([("model 2", "m"), ("1 6 FSI", "f"), ("1.6 fsi", "f"), ("MODEL", "w"), ("6 fsi", "cut"), ("", "x"), (None, "y"), ("model 2", "n")], "term string, target string")
    hits = vocabulary.read_terms(docs, "id", "text", terms, "term", "target")
    assert sorted((r.id, r.place, r.term, r.target) for r in hits.collect()) == [
        (1, 1, "MODEL", "w"), (1, 6, "1 6 FSI", "f"), (1, 9, "MODEL", "w"), (1, 9, "MODEL 2", "m"), (1, 9, "MODEL 2", "n"), (4, 0, "MODEL", "w"), (4, 0, "MODEL 2", "m"), (4, 0, "MODEL 2", "n"), (4, 2, "MODEL", "w"), (4, 2, "MODEL 2", "m"), (4, 2, "MODEL 2", "n"), (5, 0, "MODEL", "w"),
    ]
    got = {r.id: (r.term, r.target, r.n_targets) for r in vocabulary.named(hits, "id", F.lit(0)).collect()}
    assert got == {1: ("MODEL 2", None, 2), 4: ("MODEL 2", None, 2), 5: ("MODEL", "w", 1)}
    assert vocabulary.read_terms(docs.limit(0), "id", "text", terms, "term", "target").count() == 0 and vocabulary.read_terms(docs, "id", "text", terms.limit(0), "term", "target").count() == 0


def test_cascade_ways(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 5), (4, "c", 5), (5, None, 5), (6, "t", 9), (1, "a", 5)], "id int, k string, n int")
    first = spark.createDataFrame([("a", "A", 3), ("a", "A", 3), ("b", "B1", 0), ("b", "B2", 0), (None, "N", 0)], "k string, target string, least int")
    second = spark.createDataFrame([("a", "late"), ("c", "C")], "k string, target string")
    stages = [cascade.Stage("out", test=F.col("n") > 8), cascade.Stage("first", first, {"k": F.col("k")}, F.col("n") >= F.col("r_least")), cascade.Stage("second", second, {"k": F.col("k")})]
    got = {r.id: (r.branch, r.outcome, r.target, r.trace[-1]) for r in cascade.resolve(rows, "id", stages).collect()}
    assert got == {1: ("first", "resolved", "A", "first:resolved"), 2: ("second", "resolved", "late", "second:resolved"), 3: ("first", "ambiguous", None, "first:ambiguous"), 4: ("second", "resolved", "C", "second:resolved"), 5: (None, "unresolved", None, "second:none"), 6: ("out", "terminal", None, "out:terminal")}
    assert cascade.resolve(rows.limit(0), "id", stages).count() == 0
    with pytest.raises(ValueError):
        cascade.resolve(rows, "id", [stages[0], stages[0]])


def test_weighted_sweep_on_odd_rows(spark):
    rows = [(3.0, 1, 2.0), (2.0, 0, 1.0), (2.0, 1, 1.0), (1.0, 1, 4.0), (None, 1, 1.0), (5.0, None, 1.0), (5.0, 1, None), (5.0, 1, 0.0), (5.0, 1, -1.0)]
    df = spark.createDataFrame(rows, "s double, y int, w double")
    got = [(r.threshold, r.n_selected, r.precision, r.recall, r.effective, r.decidable) for r in compare.weighted_sweep(df, "s", "y", "w", 2.0).orderBy("threshold").collect()]
    assert got == [(1.0, 4, 0.875, 1.0, round(64 / 22, 6), True), (2.0, 3, 0.75, round(3 / 7, 6), round(16 / 6, 6), True), (3.0, 1, 1.0, round(2 / 7, 6), 1.0, False)]
    assert compare.weighted_sweep(df.limit(0), "s", "y", "w").count() == 0
    assert {r.recall for r in compare.weighted_sweep(df.withColumn("y", F.lit(0)), "s", "y", "w").collect()} == {0.0}


def test_proposals_by_the_narrowest_projection(spark):
    known = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "w"), ("b", None, "w"), ("c", 3, "v"), (None, None, "u"), (None, None, "u")], "k string, n int, value string")
    asked = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 9), (4, "c", 3), (5, None, None), (6, "b", None), (1, "a", 1)], "id int, k string, n int")
    got = {r.id: (r.value, r.profile, r.n_support) for r in compare.projected_proposals(known, asked, "id", [["k", "n"], ["k"]], "value").collect()}
    # b is unique by itself alone; c has too little support; nulls propose nothing.
    assert got == {1: ("x", 0, 2), 3: ("w", 1, 2), 6: ("w", 1, 2)}
    assert compare.projected_proposals(known.limit(0), asked, "id", [["k", "n"], ["k"]], "value").count() == 0
    with pytest.raises(ValueError):
        compare.projected_proposals(known, asked, "id", [["k"], ["k", "n"]], "value")


def test_scoped_rules_disagree_but_never_unite(spark):
    rules = spark.createDataFrame([("r1", "v", ["a"], "m", None), ("r2", "v", ["a", "a", None], "m", None), ("r3", "v", ["b"], None, None), ("r4", "w", ["a"], None, None), ("r5", "w", ["b"], None, None), ("r6", "u", None, None, None)], "rule_id string, value string, allowed array<string>, maker string, model string")
    pairs = spark.createDataFrame([(1, "v", ["a"], "m"), (2, "v", ["b"], "m"), (3, "v", ["b"], "n"), (4, "w", ["a"], "m"), (5, "w", ["w", "a"], "m"), (6, None, ["a"], "m"), (7, "z", ["a"], "m"), (8, "v", [], "m"), (9, "v", None, None), (10, "z", None, None)], "id int, source string, targets array<string>, maker string")
    pairs = pairs.withColumn("model", F.lit(None).cast("string"))
    got = {r.id: (r.state, r.rule_ids) for r in compare.scoped_comparison(pairs, "source", F.col("targets"), rules.withColumn("allowed", F.filter("allowed", lambda x: x.isNotNull())), [["maker", "model"], ["maker"], []]).collect()}
    assert got == {
        1: ("compatible", ["r1", "r2"]), 2: ("conflicting", ["r1", "r2"]), 3: ("compatible", ["r3"]), 4: ("conflicting", ["r4", "r5"]), 5: ("equivalent", []), 6: ("unknown", []), 7: ("conflicting", []), 8: ("unknown", ["r1", "r2"]), 9: ("unknown", ["r3"]), 10: ("unknown", []),
    }


def test_summaries_kept_equal_a_recount(spark):
    df = lambda rows: spark.createDataFrame(rows, "k int, a string, b string, m double")
    old = [(1, "x", "p", 0.1), (2, "x", None, 0.2), (3, None, "p", None), (4, "y", "q", 5.0), (4, "y", "q", 5.0)]
    new = [(1, "x", "p", 0.1), (2, "z", None, 0.3), (4, "y", "q", 5.0), (4, "y", "q", 5.0), (5, "n", "p", -1.0)]
    by, m = {"a": F.col("a"), "b": F.col("b")}, F.col("m")
    rows = lambda s: sorted((r.kind, str(r.value), r.n, float(r.total)) for r in s.collect())
    kept = summaries.update(summaries.summarise(df(old), by, m), df(old[1:3]), df([new[1], new[4]]), by, m)
    assert rows(kept) == rows(summaries.summarise(df(new), by, m)) and summaries.disagreements(kept).count() == 0
    assert rows(summaries.update(kept, df(new), df([]), by, m)) == [] and summaries.summarise(df([]), by, m).count() == 0
    wrong = kept.where("NOT (kind = 'a' AND value <=> 'z')")
    assert [r.kind for r in summaries.disagreements(wrong).collect()] == ["a"]
