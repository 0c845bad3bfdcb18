"""Queries over evidence classes, link summaries, equivalent groups and changes of code tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classify
from .registry import Tables, query


@query("""WITH x AS (SELECT l_orderkey, l_returnflag AS v, CASE l_returnflag WHEN 'A' THEN 'back' WHEN 'R' THEN 'back' WHEN 'N' THEN CASE WHEN l_linenumber < 6 THEN 'kept' END END AS m FROM lineitem),
g AS (SELECT o_orderkey, count(v) AS n, count(m) AS known, min(m) AS a, max(m) AS b FROM orders LEFT JOIN x ON o_orderkey = l_orderkey GROUP BY o_orderkey),
t AS (SELECT *, CASE WHEN n = 0 THEN 'missing' WHEN known < n THEN 'unmapped' WHEN a <> b THEN 'mixed' ELSE 'single' END AS evidence FROM g)
SELECT o_orderkey, evidence, CASE WHEN evidence = 'single' THEN a END AS value FROM t""")
def evidence_classes(t: Tables) -> DataFrame:
    x = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    v = F.col("l_returnflag")
    return classify.evidence_class(x, ["o_orderkey"], v, F.when(v.isin("A", "R"), "back").when((v == "N") & (F.col("l_linenumber") < 6), "kept"))


@query("""WITH n AS (SELECT o_custkey AS c_custkey, count(DISTINCT o_orderkey) AS n, min(o_orderstatus) AS a, max(o_orderstatus) AS b FROM orders GROUP BY o_custkey)
SELECT c_custkey, CASE WHEN n = 1 THEN 'linked' WHEN n > 1 AND a = b THEN 'multiple:' || a WHEN n > 1 THEN 'multiple' WHEN known IS NOT NULL THEN 'type_known' ELSE 'missing' END AS summary
FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS known FROM customer) LEFT JOIN n USING (c_custkey)""")
def link_summaries(t: Tables) -> DataFrame:
    owners = t.customer.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("known"))
    return classify.link_summary(owners, t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "o_orderkey", "o_orderstatus", "known")


@query("SELECT p_name, p_brand, p_type, p_size, min(p_partkey) AS representative, count(*) AS n_equal FROM part GROUP BY ALL HAVING count(*) > 1")
def equivalent_candidates(t: Tables) -> DataFrame:
    return classify.equivalent_groups(t.part, "p_partkey", ["p_name", "p_brand", "p_type", "p_size"])


@query("""WITH g AS (SELECT user_id, min({'event_type': event_type, 'k': props}) AS a, max({'event_type': event_type, 'k': props}) AS b, count(*) AS n_rows FROM events GROUP BY user_id)
SELECT user_id, a.event_type AS event_type, a.k AS props, n_rows, a IS DISTINCT FROM b AS conflict FROM g""")
def source_key_conflicts(t: Tables) -> DataFrame:
    return classify.one_per_source_key(t.events, "user_id", ["event_type", "props"])


@query("""WITH b AS (SELECT p_type || p_size AS code, min(p_brand) AS m FROM part WHERE p_size < 45 GROUP BY 1), a AS (SELECT p_type || p_size AS code, max(p_brand) AS m FROM part WHERE p_size > 5 GROUP BY 1),
c AS (SELECT coalesce(a.code, b.code) AS code, CASE WHEN b.code IS NULL THEN 'added' WHEN a.code IS NULL THEN 'removed' WHEN a.m IS DISTINCT FROM b.m THEN 'changed' END AS change FROM a FULL JOIN b ON a.code = b.code)
SELECT p_partkey, code, change FROM part JOIN c ON p_type || p_size = code WHERE change IS NOT NULL""")
def changed_codes_touch(t: Tables) -> DataFrame:
    part = t.part.withColumn("code", F.concat("p_type", F.col("p_size").cast("string")))
    before = part.where("p_size < 45").groupBy("code").agg(F.min("p_brand").alias("meaning"))
    after = part.where("p_size > 5").groupBy("code").agg(F.max("p_brand").alias("meaning"))
    return classify.touched_by_codes(part.select("p_partkey", "code"), before, after, "code", "meaning")


@query(r"""SELECT l_orderkey, l_linenumber, regexp_matches(' ' || regexp_replace(regexp_replace(text, '([0-9])[.,]([0-9])', '\1_\2', 'g'), '([0-9])[.,]([0-9])', '\1_\2', 'g') || ' ', '[^0-9_]' || l_linenumber || '[^0-9_]') AS whole
FROM (SELECT l_orderkey, l_linenumber, l_returnflag || ' ' || l_quantity::INT || '.' || l_linenumber || ' x' || (l_quantity::INT % 9) || CASE WHEN l_orderkey % 2 = 0 THEN '. b' ELSE ', 3,' END || (l_orderkey % 8) || '.2' AS text FROM lineitem)""")
def decimal_safe_numbers(t: Tables) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    text = F.concat(
        "l_returnflag", F.lit(" "), q.cast("string"), F.lit("."), F.col("l_linenumber").cast("string"), F.lit(" x"), (q % 9).cast("string"), F.when(F.col("l_orderkey") % 2 == 0, ". b").otherwise(", 3,"),
        (F.col("l_orderkey") % 8).cast("string"), F.lit(".2"),
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", classify.holds_number(text, F.col("l_linenumber")).alias("whole"))


@query(r"""WITH p AS (SELECT l_orderkey, l_linenumber, regexp_extract_all(p_brand || ' ' || p_size, '[0-9]+') AS x, regexp_extract_all(p_type || ' ' || CASE WHEN l_quantity::INT % 4 = 1 THEN p_brand || '/' || p_size WHEN l_quantity::INT % 4 = 2 THEN p_size || p_brand WHEN l_quantity::INT % 4 = 3 THEN p_brand || p_brand || ' ' || p_size ELSE '' END, '[0-9]+') AS y,
regexp_extract_all(p_type || ' ' || CASE WHEN l_quantity::INT % 4 > 0 THEN (l_quantity::INT)::VARCHAR || '/' || l_linenumber ELSE '' END, '[0-9]+') AS z
FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, l_linenumber, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 'none' WHEN x = y THEN 'equal' ELSE 'conflict' END AS relation,
CASE WHEN len(x) = 0 OR len(z) = 0 THEN 'none' WHEN x = z THEN 'equal' WHEN x <> z THEN 'conflict' END AS line_relation FROM p""")
def series_relations(t: Tables) -> DataFrame:
    """A part's brand and size against its own name put otherwise (relation) and against the line's quantity and number
    (line_relation)."""
    quantity, size = F.col("l_quantity").cast("int"), F.col("p_size").cast("string")
    q = quantity % 4
    a = F.concat("p_brand", F.lit(" "), size)
    other = F.when(q == 1, F.concat("p_brand", F.lit("/"), size)).when(q == 2, F.concat(size, "p_brand")).when(q == 3, F.concat("p_brand", "p_brand", F.lit(" "), size)).otherwise("")
    line = F.when(q > 0, F.concat(quantity.cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"))).otherwise("")
    relations = (classify.series_relation(a, F.concat("p_type", F.lit(" "), b)).alias(n) for b, n in ((other, "relation"), (line, "line_relation")))
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", *relations)
