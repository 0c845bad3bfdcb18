"""Queries of weighted calibration, proposals by projections, and comparison by scoped rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compare, summaries
from ..sources.shared import stored
from .registry import Tables, query


@query("""WITH x AS (SELECT greatest(n_chars, 0) AS s, quality, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE 0.5::DOUBLE * (doc_id % 7) END AS w FROM labels JOIN documents USING (doc_id)),
p AS (SELECT s AS threshold, count(*) AS n, sum(w) AS w, sum(w * w) AS w2, sum(w * quality) AS k FROM x WHERE w > 0 GROUP BY 1),
c AS (SELECT threshold, sum(n) OVER o AS n, sum(w) OVER o AS w, sum(w2) OVER o AS w2, sum(k) OVER o AS k, sum(k) OVER () AS all_k FROM p WINDOW o AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, k / w AS p, w * w / w2 AS e FROM c)
SELECT threshold, n::BIGINT AS n_selected, round(p, 6) AS precision, round(k / all_k, 6) AS recall, round(e, 6) AS effective,
round((p + 1.96 * 1.96 / (2 * e) - 1.96 * sqrt((p * (1 - p) + 1.96 * 1.96 / (4 * e)) / e)) / (1 + 1.96 * 1.96 / e), 6) AS precision_low, round(e, 6) >= 30 AS decidable FROM e""".replace("1.96", "1.96::DOUBLE"))
def weighted_sweep(t: Tables) -> DataFrame:
    """Documents' lengths as a score of their quality, with weights of their own."""
    rows = t.labels.join(t.documents, "doc_id").select(F.greatest("n_chars", F.lit(0)).alias("s"), "quality", F.when(F.col("doc_id") % 9 != 0, F.lit(0.5) * (F.col("doc_id") % 7)).alias("w"))
    return compare.weighted_sweep(rows, "s", "quality", "w")


#: Fields of a part's fingerprint, and nested parts of them from the narrowest on.
PROFILES = [["name", "type", "digit", "tens"], ["name", "type", "digit"], ["name", "digit"], ["tens", "digit"]]
_FIELDS = "p_name AS name, CASE WHEN p_partkey % 11 <> 0 THEN p_type END AS type, CASE WHEN p_partkey % 13 <> 0 THEN p_size % 10 END AS digit, floor(p_retailprice / 10) AS tens"

_BAND = "CASE WHEN p_size > 25 THEN 'big' ELSE 'little' END"


def _profiles_sql() -> str:
    each = " UNION ALL ".join(
        f"SELECT p_partkey, {i} AS profile, c.band, c.n_support FROM unknown u JOIN (SELECT {', '.join(p)}, min(band) AS band, count(*) AS n_support FROM known GROUP BY {', '.join(p)} HAVING min(band) = max(band) AND count(*) >= 2) c USING ({', '.join(p)})"
        for i, p in enumerate(PROFILES)
    )
    return f"WITH known AS (SELECT {_FIELDS}, {_BAND} AS band FROM part WHERE p_partkey % 4 > 0), unknown AS (SELECT p_partkey, {_FIELDS} FROM part WHERE p_partkey % 4 = 0), a AS ({each}) SELECT p_partkey, band, profile::INT AS profile, n_support FROM a QUALIFY profile = min(profile) OVER (PARTITION BY p_partkey)"


@query(_profiles_sql())
def projected_proposals(t: Tables) -> DataFrame:
    """The band of size of a fourth of the parts from what the others with equal fields have."""
    fields = _FIELDS.split(", ")
    known, unknown = t.part.where("p_partkey % 4 > 0").selectExpr(*fields, f"{_BAND} AS band"), t.part.where("p_partkey % 4 = 0").selectExpr("p_partkey", *fields)
    return compare.projected_proposals(known, unknown, "p_partkey", PROFILES, "band")




@query("""WITH r AS (SELECT 'R' || p_partkey AS rule_id, CASE WHEN p_partkey % 3 < 2 THEN p_brand END AS brand, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS size, p_type AS value, list_sort(list_distinct(string_split(p_name, ' '))) AS allowed
  FROM part WHERE p_partkey % 5 = 0 AND NOT (p_partkey % 3 = 2 AND p_type IN ('SMALL', 'PROMO'))),
s AS (SELECT p_partkey, p_brand AS brand, p_size AS size, CASE WHEN p_partkey % 10 <> 3 THEN p_type END AS source, CASE WHEN p_partkey % 10 = 4 THEN [] WHEN p_partkey % 10 = 6 THEN [p_type] ELSE string_split(p_name, ' ') END AS targets FROM part),
g0 AS (SELECT brand, size, value, min(allowed) AS a, max(allowed) AS b, list_sort(list(DISTINCT rule_id)) AS ids FROM r WHERE brand IS NOT NULL AND size IS NOT NULL GROUP BY ALL),
g1 AS (SELECT brand, value, min(allowed) AS a, max(allowed) AS b, list_sort(list(DISTINCT rule_id)) AS ids FROM r WHERE brand IS NOT NULL AND size IS NULL GROUP BY ALL),
g2 AS (SELECT value, min(allowed) AS a, max(allowed) AS b, list_sort(list(DISTINCT rule_id)) AS ids FROM r WHERE brand IS NULL AND size IS NULL GROUP BY ALL),
j AS (SELECT s.*, coalesce(g0.a, g1.a, g2.a) AS a, CASE WHEN g0.a IS NOT NULL THEN g0.b WHEN g1.a IS NOT NULL THEN g1.b ELSE g2.b END AS b, CASE WHEN g0.a IS NOT NULL THEN g0.ids WHEN g1.a IS NOT NULL THEN g1.ids ELSE g2.ids END AS ids
  FROM s LEFT JOIN g0 ON g0.brand = s.brand AND g0.size = s.size AND g0.value = source LEFT JOIN g1 ON g1.brand = s.brand AND g1.value = source LEFT JOIN g2 ON g2.value = source)
SELECT p_partkey, CASE WHEN list_contains(targets, source) THEN 'equivalent' WHEN a IS NOT NULL THEN CASE WHEN a <> b THEN 'conflicting' WHEN len(targets) = 0 THEN 'unknown' WHEN len(list_intersect(a, targets)) > 0 THEN 'compatible' ELSE 'conflicting' END
  WHEN source IS NULL OR len(targets) = 0 THEN 'unknown' ELSE 'conflicting' END AS state, CASE WHEN a IS NOT NULL AND NOT coalesce(list_contains(targets, source), false) THEN array_to_string(ids, ',') ELSE '' END AS rules FROM j""")
def scoped_comparison(t: Tables) -> DataFrame:
    """A part's type against the words of its name, by rules for a brand and size, a brand, or any."""
    key = F.col("p_partkey")
    of = t.part.where("p_partkey % 5 = 0 AND NOT (p_partkey % 3 = 2 AND p_type IN ('SMALL', 'PROMO'))")
    rules = of.select(F.concat(F.lit("R"), key).alias("rule_id"), F.when(key % 3 < 2, F.col("p_brand")).alias("brand"), F.when(key % 3 == 0, F.col("p_size")).alias("size"), F.col("p_type").alias("value"), F.split("p_name", " ").alias("allowed"))
    targets = F.when(key % 10 == 4, F.array().cast("array<string>")).when(key % 10 == 6, F.array("p_type")).otherwise(F.split("p_name", " "))
    pairs = t.part.select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.when(key % 10 != 3, F.col("p_type")).alias("source"), targets.alias("targets"))
    got = compare.scoped_comparison(pairs, "source", F.col("targets"), rules, [["brand", "size"], ["brand"], []])
    return got.select("p_partkey", "state", F.array_join("rule_ids", ",").alias("rules"))


@query("""WITH o AS (SELECT CASE WHEN o_orderkey % 100 = 7 THEN 'X' WHEN o_orderkey % 100 <> 9 THEN o_orderstatus END AS status, o_orderpriority AS priority, year(o_orderdate) AS y, o_totalprice::DECIMAL(18,2) AS price, o_orderkey FROM orders WHERE o_orderkey % 100 <> 11),
e AS (SELECT unnest([{'k': 'status', 'v': status}, {'k': 'priority', 'v': priority}, {'k': 'year', 'v': y::VARCHAR}]) AS b, price FROM o)
SELECT b.k AS kind, b.v AS value, count(*) AS n, sum(price)::DOUBLE AS total FROM e GROUP BY 1, 2""")
def summary_kept_by_deltas(t: Tables) -> DataFrame:
    """Three breakdowns of orders kept through a change of three in a hundred: some get another status, some none, some go. Only
    those rows are read again; the SQL counts everything anew."""
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("y"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    breakdowns, price = {"status": F.col("status"), "priority": F.col("priority"), "year": F.col("y")}, F.col("price")
    kept = stored(summaries.summarise(rows, breakdowns, price))
    place = F.col("o_orderkey") % 100
    before = rows.where(place.isin(7, 9, 11))
    after = before.where(place != 11).withColumn("status", F.when(place == 7, "X"))
    return summaries.update(kept, before, after, breakdowns, price).withColumn("total", F.col("total").cast("double"))
