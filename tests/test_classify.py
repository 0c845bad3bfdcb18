"""Evidence classes, links, groups and changes on small tables: nulls, ties, repeated rows and empty tables."""

import duckdb
from pyspark.sql import functions as F

from mergewright.operators import classify
from mergewright.plans import classifying, registry  # noqa: F401  (the module registers its queries)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_evidence_class(spark):
    df = spark.createDataFrame([(1, None, None), (2, "a", "x"), (2, None, "y"), (3, "a", "x"), (3, "b", "y"), (4, "a", "x"), (4, "q", None), (None, "a", "x")], "k int, v string, m string")
    got = rows(classify.evidence_class(df, ["k"], F.col("v"), F.col("m")))
    assert got == sorted([(1, "missing", None), (2, "single", "x"), (3, "mixed", None), (4, "unmapped", None), (None, "single", "x")], key=str)
    assert rows(classify.evidence_class(df.limit(0), ["k"], F.col("v"), F.col("m"))) == []


def test_link_summary(spark):
    owners = spark.createDataFrame([(1, None), (2, None), (3, None), (4, "t"), (5, None)], "k int, known string")
    links = spark.createDataFrame([(1, 7, "a"), (1, 7, "a"), (2, 7, "a"), (2, 8, "a"), (3, 7, "a"), (3, 8, "b"), (9, 1, "a")], "k int, l int, kind string")
    assert rows(classify.link_summary(owners, links, "k", "l", "kind", "known")) == [(1, "linked"), (2, "multiple:a"), (3, "multiple"), (4, "type_known"), (5, "missing")]


def test_groups_and_conflicts(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a"), (5, "b")], "k int, f string")
    assert rows(classify.equivalent_groups(df, "k", ["f"])) == [("a", 3, 2), (None, 1, 2)]
    df = spark.createDataFrame([(1, None), (1, "a"), (2, "a"), (2, "a"), (3, None)], "k int, f string")
    assert rows(classify.one_per_source_key(df, "k", ["f"])) == [(1, None, 2, True), (2, "a", 2, False), (3, None, 1, False)]


def test_touched_by_codes(spark):
    table = lambda *r: spark.createDataFrame(r, "c string, m string")
    records = spark.createDataFrame([(i, c) for i, c in enumerate(["a", "b", "c", "d", "e", None])], "id int, c string")
    got = classify.touched_by_codes(records, table(("a", "1"), ("b", "1"), ("c", None), ("e", None)), table(("a", "1"), ("b", "2"), ("d", "1"), ("e", "x")), "c", "m")
    assert rows(got.select("id", "change")) == [(1, "changed"), (2, "removed"), (3, "added"), (4, "changed")]


def test_numbers_in_text(spark):
    df = spark.createDataFrame([("2.0", 2), ("x2", 2), ("12", 2), ("2 2.0", 2), ("1 2", 2), ("", 2), (None, 2)], "t string, n int")
    assert [r[0] for r in df.select(classify.holds_number(F.col("t"), F.col("n"))).collect()] == [False, True, False, True, True, False, None]
    df = spark.createDataFrame([("a3", "b 3"), ("a3 5", "5 3 3"), ("a3 5", "3"), ("a3", "4"), ("a", "4")], "a string, b string")
    assert [r[0] for r in df.select(classify.series_relation(F.col("a"), F.col("b"))).collect()] == ["equal", "conflict", "conflict", "conflict", "none"]


def test_series_of_each_line(spark, tmp_path):
    """Lines of one part and remainder have numbers of their own, which are compared in their order."""
    parts = [(1, "Brand#5", 1, "SMALL"), (2, None, 1, "SMALL"), (3, "Brand#12", 7, "TYPE 12")]
    lines = [(1, 1, 1, 5.0), (2, 1, 1, 9.0), (3, 5, 1, 1.0), (4, 1, 1, 4.0), (5, 1, 2, 5.0), (6, 1, 2, 4.0), (7, 7, 3, 4.0), (8, 7, 3, 12.0), (9, 7, 3, 3.0)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size int, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = [(1, "equal"), (2, "conflict"), (3, "conflict"), (4, "none"), (5, None), (6, "none"), (7, "conflict"), (8, "conflict"), (9, "conflict")]
    assert rows(registry.QUERIES["series_relations"](spark, str(tmp_path)).select("l_orderkey", "line_relation")) == want
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(con.sql(registry.SQL["series_relations"]).select("l_orderkey, line_relation").fetchall()) == want
