"""Queries that audit, page, slice and check: what a reviewer or an operator of the data asks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import latest, match
from ..operators.predicates import Condition, Field, compile_filter
from .registry import Tables, query
from .resolving import QUERY_PARTS, _of_each


@query(QUERY_PARTS + """, z AS (SELECT q_id, c_id, score, size_state, type_state, CASE size_state WHEN 'matched' THEN 0.05 WHEN 'unverified' THEN -0.05 WHEN 'conflicting' THEN -0.25 ELSE 0 END::DOUBLE AS se, CASE type_state WHEN 'matched' THEN 0.05 ELSE -0.15 END::DOUBLE AS te FROM rk),
m AS (SELECT q_id, count(DISTINCT size_state) = 1 AS ms, count(DISTINCT type_state) = 1 AS mt FROM z WHERE score >= 0.55 GROUP BY 1)
SELECT z.q_id, c_id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, score - (CASE WHEN ms THEN se ELSE 0 END + CASE WHEN mt THEN te ELSE 0 END))), 6) AS rescored FROM z LEFT JOIN m ON z.q_id = m.q_id""")
def two_pass_rescoring(t: Tables) -> DataFrame:
    part = lambda n, on, off, near: F.struct(F.lit(n).alias("name"), F.when(F.array_contains("matched", n), "matched").when(F.array_contains("conflicting", n), "conflicting").when(F.col("q_size").isNull() & F.lit(n == "size"), "missing").otherwise("unverified").alias("state"), F.when(F.array_contains("matched", n), on).when(F.array_contains("conflicting", n), off).when(F.col("q_size").isNull() & F.lit(n == "size"), 0.0).otherwise(near).alias("effect"))
    pieces = F.array(part("size", 0.05, -0.25, -0.05), part("type", 0.05, -0.15, 0.0))
    return _of_each(lambda x: match.second_pass(x.withColumn("pieces", pieces), "q_id", "pieces").select("q_id", "c_id", "rescored"), t)


@query("""WITH l AS (SELECT o_custkey AS k, o_custkey + 500000 AS entity FROM orders WHERE o_custkey % 3 = 0 GROUP BY ALL), o AS (SELECT c_name AS n, min(c_custkey) + 900000 AS entity FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1)
SELECT c_custkey, coalesce(l.entity, o.entity, c_custkey) AS entity, CASE WHEN l.entity IS NOT NULL THEN 'link' WHEN o.entity IS NOT NULL THEN 'owner' ELSE 'minted' END AS link_method
FROM customer LEFT JOIN l ON c_custkey = k LEFT JOIN o ON c_name = n""")
def identity_resolution(t: Tables) -> DataFrame:
    links = t.orders.where("o_custkey % 3 = 0").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_custkey") + 500000).alias("entity")).distinct()
    owners = t.customer.where("c_custkey % 2 = 0").select("c_name", (F.col("c_custkey") + 900000).alias("entity"))
    return match.resolve_identity(t.customer.select("c_custkey", "c_name"), links, owners, "c_custkey", "c_name", F.col("c_custkey")).select("c_custkey", "entity", "link_method")


@query("""SELECT 'orders.o_custkey' AS reference, count(*) FILTER (c_custkey IS NULL) AS orphans, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'lineitem.l_partkey', count(*) FILTER (p_partkey IS NULL), count(*) FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
UNION ALL SELECT 'lineitem.l_suppkey', count(*) FILTER (s_suppkey IS NULL), count(*) FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey""")
def referential_checks(t: Tables) -> DataFrame:
    """Rows whose reference leads nowhere, by reference."""
    def check(name: str, child: DataFrame, key: str, parent: DataFrame, ref: str) -> DataFrame:
        side = parent.select(ref).distinct().withColumn("__there", F.lit(True))
        return child.join(side, F.col(key) == F.col(ref), "left").agg(F.count(F.when(F.col("__there").isNull(), 1)).alias("orphans"), F.count("*").alias("n")).select(F.lit(name).alias("reference"), "orphans", "n")

    a = check("orders.o_custkey", t.orders, "o_custkey", t.customer, "c_custkey")
    b = check("lineitem.l_partkey", t.lineitem, "l_partkey", t.part, "p_partkey")
    return a.unionByName(b).unionByName(check("lineitem.l_suppkey", t.lineitem, "l_suppkey", t.supplier, "s_suppkey"))


@query("""SELECT 'same brand, type and size' AS scope, 1 AS rung, count(*) AS n FROM part WHERE p_brand = 'Brand#3' AND p_type = 'SMALL' AND p_size = 10 UNION ALL SELECT 'same brand and type', 2, count(*) FROM part WHERE p_brand = 'Brand#3' AND p_type = 'SMALL' UNION ALL SELECT 'same brand', 3, count(*) FROM part WHERE p_brand = 'Brand#3'""")
def scope_ladder(t: Tables) -> DataFrame:
    """How many rows each wider scope of a ruling would touch; one scan."""
    fields = {"brand": Field("p_brand"), "type": Field("p_type"), "size": Field("p_size", "number")}
    facts = [Condition("brand", "equals", ("Brand#3",)), Condition("type", "equals", ("SMALL",)), Condition("size", "equals", (10,))]
    rungs = [("same brand, type and size", facts), ("same brand and type", facts[:2]), ("same brand", facts[:1])]
    one = t.part.agg(*(F.count(F.when(compile_filter(f, fields), 1)).alias(f"r{i}") for i, (_, f) in enumerate(rungs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("scope"), F.lit(i + 1).alias("rung"), F.col(f"r{i}").alias("n")) for i, (n, _) in enumerate(rungs)))).alias("x")).select("x.*")


@query("""SELECT CASE WHEN trim(p_name) <> '' THEN 'N' ELSE '-' END || CASE WHEN p_brand <> 'Brand#2' THEN 'B' ELSE '-' END || CASE WHEN p_type <> 'SMALL' THEN 'T' ELSE '-' END || CASE WHEN p_size % 7 <> 0 THEN 'S' ELSE '-' END AS presence, count(*) AS n FROM part GROUP BY 1""")
def presence_profile(t: Tables) -> DataFrame:
    has = lambda c, mark: F.when(c, mark).otherwise("-")
    mark = F.concat(has(F.trim("p_name") != "", "N"), has(F.col("p_brand") != "Brand#2", "B"), has(F.col("p_type") != "SMALL", "T"), has(F.col("p_size") % 7 != 0, "S"))
    return t.part.groupBy(mark.alias("presence")).agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT p_name AS long, CASE WHEN p_partkey % 4 = 0 THEN split_part(p_name, ' ', 1) ELSE p_name END AS short FROM part)
SELECT short, long, count(*) AS n FROM n WHERE starts_with(long, short || ' ') GROUP BY ALL""")
def qualifier_loss(t: Tables) -> DataFrame:
    """Values that a stage cut to a strict prefix of whole words."""
    x = t.part.select(F.col("p_name").alias("long"), F.when(F.col("p_partkey") % 4 == 0, F.split("p_name", " ")[0]).otherwise(F.col("p_name")).alias("short"))
    return x.where(F.col("long").startswith(F.concat("short", F.lit(" ")))).groupBy("short", "long").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT o_custkey, o_orderstatus, o_orderdate, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS i FROM orders)
SELECT o_custkey, count(*) AS claims, count(*) > 1 AS contested FROM c WHERE i = 1 GROUP BY 1""")
def one_current_owner(t: Tables) -> DataFrame:
    """Identifiers with more than one current claim."""
    current = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("last"))
    return current.groupBy("o_custkey").agg(F.count("*").alias("claims")).withColumn("contested", F.col("claims") > 1)


@query("""SELECT l_suppkey, l_returnflag, min(year(l_shipdate))::INT AS from_year, max(year(l_shipdate))::INT AS to_year, max(year(l_shipdate)) - min(year(l_shipdate)) > 4 AS too_wide FROM lineitem GROUP BY ALL""")
def rule_eras(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.min(F.year("l_shipdate")).alias("from_year"), F.max(F.year("l_shipdate")).alias("to_year"))
    return g.withColumn("too_wide", F.col("to_year") - F.col("from_year") > 4)


@query("""WITH f AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'), p AS (SELECT * FROM f ORDER BY o_totalprice DESC, o_orderkey LIMIT 25) SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM f) AS total FROM p""")
def page_with_total(t: Tables) -> DataFrame:
    """A page and the number of all rows behind it; the page is cut before the count joins it."""
    rows = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    page = rows.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)
    return page.join(F.broadcast(rows.agg(F.count("*").alias("total"))))


@query("""SELECT regexp_replace(source, '[0-9]+', '#', 'g') AS pattern, count(*) AS n, count(DISTINCT source) AS batches, min(doc_id) AS first_id, max(doc_id) AS last_id, array_to_string((list_sort(list(DISTINCT source)))[1:4], ',') AS examples FROM documents GROUP BY 1""")
def pattern_inventory(t: Tables) -> DataFrame:
    """Names with their numbers collapsed: how often, over how many names, first and last record, up to four examples."""
    names = t.documents.groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    g = names.groupBy(F.regexp_replace("source", "[0-9]+", "#").alias("pattern")).agg(F.sum("n").alias("n"), F.count("*").alias("batches"), F.min("a").alias("first_id"), F.max("b").alias("last_id"), F.array_sort(F.collect_set("source")).alias("e"))
    return g.withColumn("examples", F.array_join(F.slice("e", 1, 4), ",")).drop("e")


@query("""WITH k AS (SELECT c_custkey FROM customer ORDER BY md5('slice|' || c_custkey), c_custkey LIMIT 200), o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM k)), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
SELECT 'customer' AS tab, count(*) AS n, sum(c_custkey)::BIGINT AS key_sum FROM k UNION ALL SELECT 'orders', count(*), sum(o_orderkey)::BIGINT FROM o UNION ALL SELECT 'lineitem', count(*), sum(l_orderkey)::BIGINT FROM l""")
def slice_manifest(t: Tables) -> DataFrame:
    """A seeded slice of one table with what belongs to it in others, and the manifest that a copy is verified by."""
    keys = latest.seeded_sample(t.customer.select("c_custkey"), "c_custkey", "slice", 200).select("c_custkey")
    orders = t.orders.join(keys, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    lines = t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    one = lambda name, df, key: df.agg(F.count("*").alias("n"), F.sum(key).alias("key_sum")).select(F.lit(name).alias("tab"), "n", "key_sum")
    return one("customer", keys, "c_custkey").unionByName(one("orders", orders, "o_orderkey")).unionByName(one("lineitem", lines, "l_orderkey"))


@query("""WITH s AS (SELECT o_orderkey, o_orderstatus AS old_state, CASE WHEN o_totalprice > 400000 THEN 'R' ELSE o_orderstatus END AS new_state, o_orderpriority = '1-URGENT' AS locked, o_totalprice > 480000 AS conflict FROM orders)
SELECT CASE WHEN locked AND new_state <> old_state THEN 'blocked_locked' WHEN conflict AND new_state <> old_state THEN 'blocked_conflict' WHEN new_state = old_state THEN 'unchanged' WHEN new_state = 'R' AND old_state = 'O' THEN 'gained' WHEN new_state = 'R' AND old_state = 'F' THEN 'moved' ELSE 'other' END AS outcome, count(*) AS n, count(DISTINCT old_state) AS states FROM s GROUP BY 1""")
def what_if_outcomes(t: Tables) -> DataFrame:
    """What a hypothetical ruling would do to each row in its scope, first reason first."""
    old, new = F.col("o_orderstatus"), F.when(F.col("o_totalprice") > 400000, "R").otherwise(F.col("o_orderstatus"))
    changed = new != old
    outcome = match.first_blocker({"blocked_locked": (F.col("o_orderpriority") == "1-URGENT") & changed, "blocked_conflict": (F.col("o_totalprice") > 480000) & changed, "unchanged": ~changed, "gained": (new == "R") & (old == "O"), "moved": (new == "R") & (old == "F")})
    return t.orders.groupBy(F.coalesce(outcome, F.lit("other")).alias("outcome")).agg(F.count("*").alias("n"), F.countDistinct("o_orderstatus").alias("states"))


@query("""WITH r AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS i FROM events),
l AS (SELECT user_id, max(ts) FILTER (event_type = 'view') AS evaluated, max(ts) FILTER (event_type = 'purchase') AS updated, max(ts) FILTER (event_type = 'error') AS corrected FROM r WHERE i = 1 GROUP BY 1)
SELECT user_id, evaluated IS NULL OR coalesce(updated > evaluated, false) OR coalesce(corrected > evaluated, false) AS stale FROM l""")
def staleness(t: Tables) -> DataFrame:
    """Whether anything that a result rests on is newer than the result; one aggregate, no correlated lookups."""
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    g = t.events.groupBy("user_id").agg(last("view").alias("evaluated"), last("purchase").alias("updated"), last("error").alias("corrected"))
    newer = lambda c: F.coalesce(F.col(c) > F.col("evaluated"), F.lit(False))
    return g.select("user_id", (F.col("evaluated").isNull() | newer("updated") | newer("corrected")).alias("stale"))


@query("""WITH v AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT o_custkey, sum(n) AS total, max(n) AS best FROM v GROUP BY 1) SELECT v.o_custkey, min(o_orderstatus) AS majority, best AS votes, total::BIGINT AS total FROM v JOIN t ON v.o_custkey = t.o_custkey AND n = best GROUP BY ALL""")
def majority_per_key(t: Tables) -> DataFrame:
    counted = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    best = counted.groupBy("o_custkey").agg(F.min(F.struct((-F.col("n")).alias("m"), "o_orderstatus")).alias("b"), F.sum("n").alias("total"))
    return best.select("o_custkey", F.col("b.o_orderstatus").alias("majority"), (-F.col("b.m")).alias("votes"), "total")


@query("""SELECT b.l_suppkey, count(*) AS n, count(*) OVER () AS groups FROM lineitem b GROUP BY 1""")
def groups_with_count(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return g.join(F.broadcast(g.agg(F.count("*").alias("groups"))))


@query("""SELECT doc_id, text, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id)::INT AS rank FROM documents QUALIFY rank <= 5""")
def longest_per_language(t: Tables) -> DataFrame:
    """The page is cut by narrow columns before the wide text joins it."""
    narrow = t.documents.select("doc_id", "lang", "n_chars")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    page = narrow.withColumn("rank", rank).where("rank <= 5").select("doc_id", "rank")
    return t.documents.select("doc_id", "text").join(page, "doc_id")
