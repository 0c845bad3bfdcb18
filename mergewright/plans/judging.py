"""Queries over evidence, gates, rules and reviews over time, hierarchies and references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evidence, hierarchy, lifecycle
from ..operators.predicates import Condition, Field, compile_filter, search
from .registry import Tables, query

PAIRS = """WITH p AS (SELECT l_orderkey, l_linenumber, year(l_shipdate) AS y, CASE WHEN p_size % 7 <> 0 THEN 1993 + p_size % 5 END AS y0, CASE WHEN p_size % 11 <> 0 THEN 1995 + p_size % 5 + p_size % 3 END AS y1,
(l_quantity * 10)::INT AS cc, p_size * 10 + l_linenumber - 3 AS cc2, p_brand = 'Brand#1' AS rotary, 4 * l_quantity AS kw, 4 * (p_size + l_linenumber - 3.0::DOUBLE) AS kw2, p_brand = 'Brand#2' AND l_returnflag = 'R' AS units, l_linenumber % 2 = 0 AS alone,
l_returnflag = 'A' AS electric, l_returnflag = 'N' AS hybrid, year(l_shipdate) < 1993 AS veteran, l_returnflag AS drive, p_type AS body, p_size / 50.0::DOUBLE AS text, l_discount AS margin,
month(l_shipdate) AS m FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _pairs(t: Tables) -> DataFrame:
    c = F.col
    x = t.lineitem.join(t.part, c("l_partkey") == c("p_partkey"))
    return x.select(
        "l_orderkey", "l_linenumber", F.year("l_shipdate").alias("y"), F.when(c("p_size") % 7 != 0, 1993 + c("p_size") % 5).alias("y0"), F.when(c("p_size") % 11 != 0, 1995 + c("p_size") % 5 + c("p_size") % 3).alias("y1"),
        (c("l_quantity") * 10).cast("int").alias("cc"), (c("p_size") * 10 + c("l_linenumber") - 3).alias("cc2"), (c("p_brand") == "Brand#1").alias("rotary"), (4 * c("l_quantity")).alias("kw"), (4 * (c("p_size") + c("l_linenumber") - F.lit(3.0))).alias("kw2"), ((c("p_brand") == "Brand#2") & (c("l_returnflag") == "R")).alias("units"), (c("l_linenumber") % 2 == 0).alias("alone"),
        (c("l_returnflag") == "A").alias("electric"), (c("l_returnflag") == "N").alias("hybrid"), (F.year("l_shipdate") < 1993).alias("veteran"), c("l_returnflag").alias("drive"), c("p_type").alias("body"), (c("p_size") / F.lit(50.0)).alias("text"), c("l_discount").alias("margin"), F.month("l_shipdate").alias("m"),
    )


def _told(df: DataFrame, e) -> DataFrame:
    return df.withColumn("e", e).select("l_orderkey", "l_linenumber", "e.name", "e.state", "e.effect")


def _effect(cases: list[tuple[str, str, str, float]]) -> str:
    """SQL of the first of (test, name, state, effect) that holds."""
    part = lambda i: "CASE " + " ".join(f"WHEN {c[0]} THEN {c[i]!r}" for c in cases) + " END"
    return f"{PAIRS} SELECT l_orderkey, l_linenumber, {part(1)} AS name, {part(2)} AS state, ({part(3)})::DOUBLE AS effect FROM p"


_GAP = "greatest(0, y0 - y, y - y1)"


@query(_effect([
    ("y0 IS NULL AND y1 IS NULL", "year", "missing", 0.0), (f"{_GAP} = 0 AND y = y0 AND m < 3", "year_month_outside_unverified", "unverified", -0.05), (f"{_GAP} = 0", "year", "matched", 0.05),
    (f"{_GAP} <= 1", "year_adjacent_unverified", "unverified", -0.05), ("true", "year", "conflicting", -0.2),
]))
def evidence_year_window(t: Tables) -> DataFrame:
    """Windows with open ends among them."""
    outside = (F.col("y") == F.col("y0")) & (F.col("m") < 3)
    return _told(_pairs(t), evidence.year_window("year", F.col("y"), F.col("y0"), F.col("y1"), outside))


@query(_effect([("cc = cc2", "cc", "matched", 0.05), ("abs(cc - cc2) <= 3", "cc_rounding_unverified", "unverified", -0.05), ("rotary AND cc = 2 * cc2", "cc", "matched", 0.05), ("true", "cc", "conflicting", -0.25)]))
def evidence_displacement(t: Tables) -> DataFrame:
    return _told(_pairs(t), evidence.displacement("cc", F.col("cc"), F.col("cc2"), F.col("rotary")))


@query(_effect([
    ("kw = kw2", "kw", "matched", 0.05), ("abs(kw - kw2) <= 2", "kw", "unverified", -0.05), ("electric AND alone", "kw_electric_unverified", "unverified", -0.05), ("hybrid AND kw < kw2", "kw_hybrid_unverified", "unverified", -0.05),
    ("units AND abs(greatest(kw, kw2) - least(kw, kw2) * (0.7457::DOUBLE / 0.7355::DOUBLE)) <= 1.01", "kw_horsepower_unit_unverified", "unverified", -0.05), ("veteran", "kw_veteran_unverified", "unverified", -0.05), ("true", "kw", "conflicting", -0.25),
]))
def evidence_power(t: Tables) -> DataFrame:
    c = F.col
    return _told(_pairs(t), evidence.power("kw", c("kw"), c("kw2"), electric=c("electric"), only_near=c("alone"), hybrid=c("hybrid"), units=c("units"), veteran=c("veteran")))


@query(PAIRS + """, s AS (SELECT l_orderkey, l_linenumber, CASE WHEN (drive = 'A' AND body IN ('SMALL', 'LARGE')) THEN 'unverified' WHEN drive = 'N' AND body = 'ECONOMY' THEN 'matched' ELSE 'conflicting' END AS state FROM p)
SELECT l_orderkey, l_linenumber, 'drive_evidence' AS name, state, CASE state WHEN 'matched' THEN 0.05 WHEN 'unverified' THEN 0.0 ELSE -0.15 END::DOUBLE AS effect FROM s""")
def evidence_reviewed_pairs(t: Tables) -> DataFrame:
    table = t.spark.createDataFrame([("A", "SMALL", "compatible"), ("LARGE", "A", "compatible"), ("N", "ECONOMY", "equivalent")], "left_value string, right_value string, verdict string")
    return _told(evidence.reviewed(_pairs(t), "drive", "body", table, "drive_evidence", 0.05, 0.0, -0.15), F.col("drive_evidence"))


CONFIDENCE = PAIRS + """, c AS (SELECT *, round(round(0.5 * text, 6) + round(0.2 * CASE drive WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.65 ELSE 0.5 END, 6) + round(0.2 * CASE WHEN y BETWEEN y0 AND y1 THEN 1.0 ELSE 0.0 END, 6)
+ round(0.1 * least(1.0::DOUBLE, margin / 0.08::DOUBLE), 6), 6) AS confidence FROM p)"""


def _confident(t: Tables) -> DataFrame:
    scope = F.when(F.col("drive") == "A", "exact_manufacturer").when(F.col("drive") == "N", "fuzzy_manufacturer").otherwise("phonetic_manufacturer")
    return _pairs(t).withColumn("confidence", evidence.confidence(F.col("text"), scope, F.when(F.col("y").between(F.col("y0"), F.col("y1")), 1.0).otherwise(0.0), F.col("margin")))


@query(CONFIDENCE + " SELECT l_orderkey, l_linenumber, confidence::DOUBLE AS confidence FROM c")
def match_confidence(t: Tables) -> DataFrame:
    return _confident(t).select("l_orderkey", "l_linenumber", "confidence")


@query(CONFIDENCE + """ SELECT l_orderkey, l_linenumber, CASE WHEN abs(cc - cc2) > 200 THEN 'review:conflict' WHEN y < y0 - 2 THEN 'review:context' WHEN drive = 'R' AND m = 1 THEN 'review:scope' WHEN m = 2 THEN 'review:partial'
WHEN margin < 0.02 THEN 'review:margin' WHEN confidence >= 0.9 AND NOT veteran THEN 'resolved' WHEN confidence >= 0.7 THEN 'provisional' ELSE 'review:score' END AS route FROM c""")
def routing_gates(t: Tables) -> DataFrame:
    c = F.col
    tests = {"conflict": F.abs(c("cc") - c("cc2")) > 200, "context": c("y") < c("y0") - 2, "scope": (c("drive") == "R") & (c("m") == 1), "partial": c("m") == 2, "margin": c("margin") < 0.02}
    return _confident(t).select("l_orderkey", "l_linenumber", evidence.gates(tests, c("veteran"), c("confidence")).alias("route"))


@query(PAIRS + """ SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN abs(cc - cc2) > 200 THEN 'conflict' END, CASE WHEN drive = 'R' THEN 'scope' END, CASE WHEN text < 0.9 THEN 'threshold' END, CASE WHEN margin < 0.08 THEN 'margin' END], lambda x: x IS NOT NULL), ',') AS reasons FROM p""")
def eligibility_reasons(t: Tables) -> DataFrame:
    c = F.col
    reasons = evidence.eligibility({"conflict": F.abs(c("cc") - c("cc2")) > 200, "scope": c("drive") == "R", "threshold": c("text") < 0.9, "margin": c("margin") < 0.08})
    return _pairs(t).select("l_orderkey", "l_linenumber", F.array_join(reasons, ",").alias("reasons"))


@query("""WITH r AS (SELECT p_brand, CASE WHEN p_brand <> 'Brand#4' THEN p_type END AS p_type, p_size FROM part), a AS (SELECT DISTINCT p_brand, p_type FROM r WHERE p_size <= 25), b AS (SELECT DISTINCT p_brand, p_type FROM r WHERE p_size >= 24)
SELECT coalesce(a.p_brand, b.p_brand) AS p_brand, coalesce(a.p_type, b.p_type) AS p_type, CASE WHEN a.p_brand IS NULL THEN 'add' WHEN b.p_brand IS NULL THEN 'retire' ELSE 'keep' END AS verdict
FROM a FULL JOIN b ON a.p_brand = b.p_brand AND a.p_type IS NOT DISTINCT FROM b.p_type""")
def rules_reconciled(t: Tables) -> DataFrame:
    rules = t.part.withColumn("p_type", F.when(F.col("p_brand") != "Brand#4", F.col("p_type")))
    active, wanted = rules.where("p_size <= 25"), rules.where("p_size >= 24")
    return lifecycle.reconcile(active, wanted, ["p_brand", "p_type"]).drop("rule_id")


@query("""WITH c AS (SELECT l_suppkey, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL),
b AS (SELECT l_suppkey, l_returnflag, sum(n)::BIGINT AS siblings, max(n) AS m, arg_min(l_linestatus, {'m': -n, 'v': l_linestatus}) AS l_linestatus FROM c GROUP BY ALL)
SELECT l_suppkey, l_returnflag, l_linestatus, siblings, siblings - m AS others, greatest(1, floor(round(0.5 * siblings, 6)))::BIGINT AS tolerance FROM b WHERE siblings >= 3 AND siblings - m <= greatest(1, floor(round(0.5 * siblings, 6)))""")
def pattern_rules_tolerance(t: Tables) -> DataFrame:
    return lifecycle.validated_patterns(t.lineitem, ["l_suppkey", "l_returnflag"], "l_linestatus", 0.5, 3)


FILL_ROWS = """WITH rows AS (SELECT p_partkey, p_brand, CASE WHEN p_size > 20 THEN p_type END AS p_type, CASE WHEN p_size > 40 THEN p_name END AS p_name FROM part),
rules AS (SELECT p_brand, min(p_type) AS p_type, max(p_name) AS p_name FROM part GROUP BY 1)"""


def _fill(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.part.select("p_partkey", "p_brand", F.when(F.col("p_size") > 20, F.col("p_type")).alias("p_type"), F.when(F.col("p_size") > 40, F.col("p_name")).alias("p_name"), "p_size")
    return rows, t.part.groupBy("p_brand").agg(F.min("p_type").alias("p_type"), F.max("p_name").alias("p_name"))


@query(FILL_ROWS + """ SELECT p_partkey, r.p_brand, coalesce(r.p_type, u.p_type) AS p_type, CASE WHEN r.p_type IS NULL THEN coalesce(r.p_name, u.p_name) ELSE r.p_name END AS p_name,
CASE WHEN r.p_type IS NULL AND r.p_name IS NULL THEN 'p_type,p_name' WHEN r.p_type IS NULL THEN 'p_type' ELSE '' END AS filled FROM rows r JOIN rules u ON r.p_brand = u.p_brand""")
def apply_implied_fields(t: Tables) -> DataFrame:
    rows, rules = _fill(t)
    return lifecycle.apply_implied(rows.drop("p_size"), rules, "p_brand", "p_type", ["p_name"])


@query("""SELECT p_partkey, b.t AS proposed, CASE WHEN p_size < 5 THEN 'refused:size' WHEN starts_with(p_name, 'red') THEN 'refused:name' ELSE 'filled' END AS verdict
FROM part JOIN (SELECT p_brand AS k, min(p_type) AS t FROM part GROUP BY 1) b ON p_brand = k WHERE p_size <= 20""")
def apply_guarded_fills(t: Tables) -> DataFrame:
    rows, rules = _fill(t)
    rows = rows.drop("p_name").join(t.part.select("p_partkey", "p_name"), "p_partkey")
    guard = {"size": F.col("p_size") < 5, "name": F.col("p_name").startswith("red")}
    return lifecycle.apply_guarded(rows, rules, "p_brand", "p_type", guard).select("p_partkey", "proposed", "verdict")


#: A fold over each customer's orders in time, a step a row: the value now (v, s, d), and what registry (rv, rd) and provider
#: (pv, pd) are kept with beside it.
FOLD_SQL = """WITH RECURSIVE o AS (SELECT o_custkey AS entity, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS v, CASE WHEN o_totalprice > 200000 THEN 'registry' ELSE 'provider' END AS s, o_orderdate::DATE AS d, o_orderstatus = 'P' AS clr FROM orders),
k AS (SELECT entity, CASE WHEN clr THEN NULL ELSE v END AS v, s, d, clr, row_number() OVER (PARTITION BY entity ORDER BY d, s, v NULLS FIRST, clr) AS i, count(*) OVER (PARTITION BY entity) AS n FROM o),
f AS (
  SELECT DISTINCT entity, 0::BIGINT AS i, NULL::VARCHAR AS v, NULL::VARCHAR AS s, NULL::DATE AS d, NULL::VARCHAR AS rv, NULL::DATE AS rd, NULL::VARCHAR AS pv, NULL::DATE AS pd, NULL::VARCHAR AS does FROM k
  UNION ALL
  SELECT entity, i, CASE does WHEN 'take' THEN nv WHEN 'empty' THEN NULL WHEN 'registry' THEN rv WHEN 'provider' THEN pv ELSE v END, CASE does WHEN 'take' THEN ns WHEN 'empty' THEN NULL WHEN 'keep' THEN s WHEN 'still' THEN s WHEN 'beside' THEN s ELSE does END,
    CASE does WHEN 'take' THEN nd WHEN 'empty' THEN NULL WHEN 'registry' THEN rd WHEN 'provider' THEN pd ELSE d END,
    CASE WHEN does = 'beside' AND ns = 'registry' THEN nv WHEN does IN ('take', 'empty') AND s = 'registry' AND ns <> s THEN v WHEN (ns = 'registry' AND does <> 'still') OR does = 'registry' THEN NULL ELSE rv END,
    CASE WHEN does = 'beside' AND ns = 'registry' THEN nd WHEN does IN ('take', 'empty') AND s = 'registry' AND ns <> s THEN d WHEN (ns = 'registry' AND does <> 'still') OR does = 'registry' THEN NULL ELSE rd END,
    CASE WHEN does = 'beside' AND ns = 'provider' THEN nv WHEN does IN ('take', 'empty') AND s = 'provider' AND ns <> s THEN v WHEN (ns = 'provider' AND does <> 'still') OR does = 'provider' THEN NULL ELSE pv END,
    CASE WHEN does = 'beside' AND ns = 'provider' THEN nd WHEN does IN ('take', 'empty') AND s = 'provider' AND ns <> s THEN d WHEN (ns = 'provider' AND does <> 'still') OR does = 'provider' THEN NULL ELSE pd END, does
  FROM (SELECT f.entity, k.i, f.v, f.s, f.d, f.rv, f.rd, f.pv, f.pd, k.v AS nv, k.s AS ns, k.d AS nd,
      CASE WHEN k.v IS NULL AND NOT k.clr THEN CASE WHEN f.v IS NOT NULL AND f.s = k.s THEN CASE WHEN f.rv IS NOT NULL THEN 'registry' WHEN f.pv IS NOT NULL THEN 'provider' ELSE 'empty' END ELSE 'keep' END
        WHEN f.v IS NULL THEN CASE WHEN k.v IS NULL THEN 'still' ELSE 'take' END WHEN f.v = k.v THEN 'keep'
        WHEN k.s = 'registry' OR f.s = 'provider' THEN CASE WHEN k.v IS NULL THEN 'empty' ELSE 'take' END WHEN k.v IS NULL THEN 'keep' ELSE 'beside' END AS does
    FROM f JOIN k ON k.entity = f.entity AND k.i = f.i + 1))
SELECT f.entity, 'priority' AS field, f.v AS value, f.s AS source, f.d AS since, ((rv IS NOT NULL)::INT + (pv IS NOT NULL)::INT)::BIGINT AS n_alternatives, n AS n_observations FROM f JOIN k ON k.entity = f.entity AND k.i = f.i WHERE f.i = k.n"""


@query(FOLD_SQL)
def merge_clear_and_confirm(t: Tables) -> DataFrame:
    """Priorities of each customer's orders in time: silence, clears, confirmations, and what is kept beside."""
    o = t.orders.select(
        F.col("o_custkey").alias("entity"), F.lit("priority").alias("field"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("value"), F.when(F.col("o_totalprice") > 200000, "registry").otherwise("provider").alias("source"),
        F.col("o_orderdate").cast("date").alias("observed_on"), (F.col("o_orderstatus") == "P").alias("cleared"),
    )
    return lifecycle.fold_in_time(o, {"registry": 2, "provider": 1})


@query("""WITH c AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'set' WHEN 'O' THEN 'ignore' ELSE 'withdraw' END AS action, o_orderpriority AS v FROM orders),
h AS (SELECT o_custkey, action, v, lead(action) OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS before FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1),
m AS (SELECT c_custkey AS entity, c_mktsegment AS value, CASE WHEN c_nationkey % 2 = 0 THEN 'correction' ELSE 'registry' END AS source, lower(c_mktsegment) AS alt, h.* FROM customer LEFT JOIN h ON c_custkey = o_custkey)
SELECT entity, 'segment' AS field, CASE WHEN action = 'set' THEN v WHEN action IN ('ignore', 'withdraw') AND before = 'set' THEN alt ELSE value END AS value,
CASE WHEN action = 'set' THEN 'correction' WHEN action IN ('ignore', 'withdraw') AND before = 'set' THEN 'provider' ELSE source END AS source, coalesce(action, 'none') AS action FROM m""")
def corrections_projected(t: Tables) -> DataFrame:
    field = F.lit("segment").alias("field")
    action = F.when(F.col("o_orderstatus") == "F", "set").when(F.col("o_orderstatus") == "O", "ignore").otherwise("withdraw")
    corrections = t.orders.select(F.col("o_custkey").alias("entity"), field, action.alias("action"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("position"))
    merged = t.customer.select(F.col("c_custkey").alias("entity"), field, F.col("c_mktsegment").alias("value"), F.when(F.col("c_nationkey") % 2 == 0, "correction").otherwise("registry").alias("source"))
    other = t.customer.select(F.col("c_custkey").alias("entity"), field, F.lower("c_mktsegment").alias("value"), F.lit("provider").alias("source"))
    return lifecycle.project_corrections(merged, corrections, other)


@query("""WITH n AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS kinds, min(o_orderpriority) AS now, bool_or(o_totalprice > 480000) AS ended FROM orders GROUP BY 1)
SELECT CASE WHEN kinds IS NULL THEN 'unknown' WHEN ended THEN 'stale_terminal' WHEN kinds > 1 THEN 'cardinality' WHEN now = '1-URGENT' THEN 'fresh' ELSE 'mismatch' END AS freshness, count(*) AS n
FROM customer LEFT JOIN n ON c_custkey = o_custkey GROUP BY 1""")
def promotion_freshness(t: Tables) -> DataFrame:
    promoted = t.customer.select(F.col("c_custkey").alias("k"), F.lit("1-URGENT").alias("v"))
    current = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"), (F.col("o_totalprice") > 480000).alias("terminal"))
    return lifecycle.freshness(promoted, current, "k", "v")


STATES = "['pending', 'in_review', 'resolved', 'rejected']"


@query(f"""WITH x AS (SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN NULL ELSE {STATES}[1 + o_custkey % 4] END AS from_state, {STATES}[1 + o_orderkey % 4] AS to_state FROM orders LEFT JOIN customer ON o_custkey + 100 = c_custkey),
v AS (SELECT *, CASE WHEN from_state IS NULL THEN 'missing' WHEN from_state = to_state THEN 'unchanged'
WHEN from_state || '>' || to_state IN ('pending>in_review', 'pending>resolved', 'pending>rejected', 'in_review>pending', 'in_review>resolved', 'in_review>rejected') THEN 'moved' ELSE 'refused' END AS verdict FROM x)
SELECT o_orderkey, from_state, to_state, verdict, CASE WHEN verdict = 'moved' THEN to_state ELSE from_state END AS state FROM v""")
def review_transitions(t: Tables) -> DataFrame:
    states = F.array(*map(F.lit, lifecycle.TRANSITIONS))
    known = t.customer.select((F.col("c_custkey") - 100).alias("c"))
    items = t.orders.join(known, F.col("o_custkey") == F.col("c"), "left_semi").select("o_orderkey", F.element_at(states, (1 + F.col("o_custkey") % 4).cast("int")).alias("state"))
    requests = t.orders.select("o_orderkey", F.element_at(states, (1 + F.col("o_orderkey") % 4).cast("int")).alias("to_state"))
    return lifecycle.transitions(items, requests, "o_orderkey")


@query("""SELECT DISTINCT o_custkey, 'resolved' AS state FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT DISTINCT o_custkey, 'pending' FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def review_queue(t: Tables) -> DataFrame:
    queue = t.orders.where("o_orderstatus = 'F'").select("o_custkey").distinct().withColumn("state", F.lit("resolved"))
    return lifecycle.enqueue(queue, t.orders, ["o_custkey"])


@query("""WITH a AS (SELECT p_brand, count(*) AS n FROM part WHERE p_brand <> 'Brand#3' GROUP BY 1), b AS (SELECT p_brand, count(*) AS n, bool_or(p_size > 48) AS other FROM part GROUP BY 1)
SELECT b.p_brand, b.n AS n_rows, CASE WHEN a.p_brand IS NULL THEN 'sealed' WHEN other OR b.p_brand = 'Brand#6' THEN 'conflict' ELSE 'replay' END AS verdict FROM b LEFT JOIN a ON a.p_brand = b.p_brand""")
def versions_sealed(t: Tables) -> DataFrame:
    changed = t.part.withColumn("p_type", F.when(F.col("p_size") > 48, "CHANGED").otherwise(F.col("p_type")))
    # An empty name where another version has none is a change as well.
    named = lambda df, other: df.withColumn("p_name", F.when(F.col("p_brand") == "Brand#6", F.lit(other)).when(F.col("p_brand") != "Brand#5", F.col("p_name")))
    return lifecycle.sealed(named(t.part.where("p_brand <> 'Brand#3'"), None), named(changed, ""), "p_brand", ["p_partkey", "p_type", "p_name"])


@query("""WITH n AS (SELECT n_nationkey, n_name, CASE WHEN n_nationkey >= 3 THEN n_regionkey ELSE -1 END AS rk FROM nation WHERE n_nationkey % 10 <> 9),
c AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 50 = 0 THEN -7 ELSE c_nationkey END AS nk FROM customer WHERE c_custkey % 40 <> 1 AND CASE WHEN c_custkey % 50 = 0 THEN -7 ELSE c_nationkey END % 10 <> 9),
o AS (SELECT CASE WHEN o_orderkey % 100 = 0 THEN NULL ELSE o_custkey END AS ck, count(*) AS k FROM orders WHERE o_orderkey % 100 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 40 = 1 OR CASE WHEN c_custkey % 50 = 0 THEN -7 ELSE c_nationkey END % 10 = 9) GROUP BY 1)
SELECT r_regionkey, CASE WHEN n_nationkey IS NOT NULL THEN n_nationkey ELSE nk END AS n_nationkey, coalesce(c_custkey, ck) AS c_custkey, r_name, n_name, c_name, coalesce(k, 0) AS n_leaves, c_custkey IS NULL OR n_nationkey IS NULL OR r_regionkey IS NULL AS missing
FROM (SELECT *, CASE WHEN rk >= 0 THEN rk ELSE NULL END AS r0 FROM c LEFT JOIN n ON nk = n_nationkey) x LEFT JOIN region ON x.rk = r_regionkey FULL JOIN o ON c_custkey = ck""".replace("SELECT r_regionkey,", "SELECT coalesce(r_regionkey, rk) AS r_regionkey,"))
def hierarchy_paths(t: Tables) -> DataFrame:
    """Region, nation, customer and their orders by ids: some nations without a region, customers without a nation, orders
    without a customer, and deleted nations and customers."""
    nation = t.nation.select("n_nationkey", "n_name", F.when(F.col("n_nationkey") >= 3, F.col("n_regionkey")).otherwise(-1).alias("r_regionkey"), (F.col("n_nationkey") % 10 == 9).alias("deleted"))
    customer = t.customer.select("c_custkey", "c_name", F.when(F.col("c_custkey") % 50 == 0, -7).otherwise(F.col("c_nationkey")).alias("n_nationkey"), (F.col("c_custkey") % 40 == 1).alias("deleted"))
    orders = t.orders.select(F.when(F.col("o_orderkey") % 100 != 0, F.col("o_custkey")).alias("c_custkey"))
    levels = [(t.region, "r_regionkey", None, "r_name"), (nation, "n_nationkey", "r_regionkey", "n_name"), (customer, "c_custkey", "n_nationkey", "c_name")]
    return hierarchy.assembled(levels, orders, "deleted")


@query("""WITH d AS (SELECT doc_id % 200 AS item_id, lang, md5(text) AS description FROM documents)
SELECT b.item_id, (SELECT min(description) FROM d WHERE d.item_id = b.item_id AND lang = 'de') AS description, NOT EXISTS (SELECT 1 FROM d WHERE d.item_id = b.item_id AND lang = 'de' AND description IS NOT NULL) AS missing FROM benchmark b""")
def language_descriptions(t: Tables) -> DataFrame:
    told = t.documents.select((F.col("doc_id") % 200).alias("item_id"), "lang", F.md5("text").alias("description"))
    return hierarchy.described(t.benchmark.select("item_id"), told, "item_id", "de")


@query("""SELECT p_partkey, array_to_string(list_filter([p_type, p_brand, CASE WHEN p_name NOT IN (p_type, p_brand) THEN p_name END], lambda v: v IS NOT NULL), '|') AS codes FROM part""")
def code_lists(t: Tables) -> DataFrame:
    text = F.concat(F.col("p_type"), F.lit(", "), F.col("p_brand"), F.lit(","), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(" "), F.lit(" ,"), F.col("p_name"))
    return t.part.select("p_partkey", F.array_join(hierarchy.listed(text), "|").alias("codes"))


@query("""WITH x AS (SELECT o_orderkey, lower(o_orderpriority[3:]) AS source, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey::VARCHAR END AS ref, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE END AS day FROM orders)
SELECT o_orderkey, source || coalesce(':' || ref, '') || coalesce('@' || strftime(day, '%Y-%m-%d'), '') AS code, source, ref, day FROM x""")
def source_references(t: Tables) -> DataFrame:
    source = F.lower(F.substring("o_orderpriority", 3, 99))
    code = hierarchy.encode_ref(source, F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey").cast("string")), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate").cast("date")))
    return t.orders.select("o_orderkey", code.alias("code")).withColumn("r", hierarchy.parse_ref(F.col("code"))).select("o_orderkey", "code", "r.source", "r.ref", "r.day")


@query("""WITH r AS (SELECT min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders), s AS (SELECT low + (high - low) * i // 25 AS seek FROM r, range(25) g(i))
SELECT seek::BIGINT AS seek, (SELECT min(o_orderkey) FROM orders WHERE o_orderkey >= seek)::BIGINT AS first_key FROM s""")
def seek_key_sample(t: Tables) -> DataFrame:
    return hierarchy.seek_sample(t.orders, "o_orderkey", 25)


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey)::INT AS place FROM orders QUALIFY place <= 50""")
def custom_priority_page(t: Tables) -> DataFrame:
    """The first page in an order of states, cut before it is numbered."""
    priority = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    page = t.orders.select("o_orderkey", priority.alias("p"), "o_totalprice").orderBy("p", F.desc("o_totalprice"), "o_orderkey").limit(50)
    rows = F.array_sort(F.collect_list(F.struct("p", (-F.col("o_totalprice")).alias("t"), "o_orderkey")))
    return page.agg(rows.alias("r")).select(F.posexplode("r").alias("at", "x")).select("x.o_orderkey", (F.col("at") + 1).alias("place"))


@query("""SELECT o_custkey, array_to_string(list_sort(list_distinct(array_agg(o_orderpriority))), ',') AS held, count(*) AS n FROM orders GROUP BY 1 HAVING list_has_any(array_agg(o_orderpriority), ['1-URGENT', '2-HIGH'])""")
def array_overlap_filter(t: Tables) -> DataFrame:
    held = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("held"), F.count("*").alias("n"))
    hit = held.where(compile_filter([Condition("held", "overlaps", ("1-URGENT", "2-HIGH"))], {"held": Field("held", "list")}))
    return hit.select("o_custkey", F.array_join("held", ",").alias("held"), "n")


PART = {"brand": Field("p_brand"), "type": Field("p_type"), "price": Field("p_retailprice", "number"), "price_text": Field("price_text", "number_text")}


@query("""SELECT p_partkey FROM part WHERE NOT (p_type IN ('SMALL', 'LARGE')) AND p_retailprice >= 905.25 AND p_retailprice <= 1400.5 AND p_name IS NOT NULL AND (p_brand IS NULL OR p_brand <> 'Brand#1')""")
def filter_fractional_bounds(t: Tables) -> DataFrame:
    wanted = [Condition("type", "not_in", ("SMALL", "LARGE")), Condition("price", "gte", (905.25,)), Condition("price", "lte", ("1400.5",)), Condition("name", "is_not_null"), Condition("brand", "not_equals", ("Brand#1",))]
    return t.part.where(compile_filter(wanted, PART | {"name": Field("p_name")})).select("p_partkey")


@query("""SELECT p_partkey FROM part WHERE CASE WHEN p_partkey % 7 = 0 THEN false ELSE p_retailprice BETWEEN 950.05 AND 1200.75 END""")
def filter_decimal_text(t: Tables) -> DataFrame:
    rows = t.part.withColumn("price_text", F.when(F.col("p_partkey") % 7 == 0, "n/a").otherwise(F.format_string("%.2f", F.round("p_retailprice", 2))))
    return rows.where(compile_filter([Condition("price_text", "between", (950.05, "1200.75"))], PART)).select("p_partkey")


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-02-29' AND o_orderdate < TIMESTAMP '1998-11-03'""")
def filter_date_bounds(t: Tables) -> DataFrame:
    day = {"day": Field("o_orderdate", "date")}
    return t.orders.where(compile_filter([Condition("day", "gte", ("1996-02-29",)), Condition("day", "lte", ("1998-11-02",))], day)).select("o_orderkey")


@query("""SELECT event_id FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 62.5 AND event_type <> 'view'""")
def filter_map_entries(t: Tables) -> DataFrame:
    rows = t.events.withColumn("props_map", F.from_json("props", "map<string,string>")).withColumn("k", F.col("props_map")["k"])
    wanted = [Condition("k", "gte", (62.5,)), Condition("kind", "not_in", ("view",))]
    return rows.where(compile_filter(wanted, {"k": Field("k", "number_text"), "kind": Field("event_type")})).select("event_id")


@query("""SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'r') AND contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'e')
AND contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'b') AND contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'd') AND contains(lower(concat_ws(' ', p_name, p_brand, p_type)), '#1')
AND contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'small')""")
def search_six_words(t: Tables) -> DataFrame:
    return t.part.where(search("R e b d #1 SMALL", ["p_name", "p_brand", "p_type"])).select("p_partkey", "p_name")
