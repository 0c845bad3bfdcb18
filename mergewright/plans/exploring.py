"""Queries that filter, count, group and sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import compare, explore, latest
from ..operators.predicates import Condition, Field, compile_filter, search
from .registry import Tables, query

PART = {"brand": Field("p_brand"), "type": Field("p_type"), "name": Field("p_name"), "size": Field("p_size", "number")}
ORDER = {"status": Field("o_orderstatus"), "priority": Field("o_orderpriority"), "total": Field("o_totalprice", "number")}


@query("""SELECT p_type AS value, count(*) AS n FROM part WHERE p_size <= 25 AND p_type IS NOT NULL
GROUP BY 1 ORDER BY n DESC, value LIMIT 5""")
def facet_top_values(t: Tables) -> DataFrame:
    return explore.facet(t.part, PART, [Condition("size", "lte", (25,))], "type", 5)


@query("""SELECT p_brand AS value, count(*) AS n FROM part WHERE p_type IN ('SMALL', 'LARGE') GROUP BY 1 ORDER BY n DESC, value LIMIT 10""")
def facet_lifted(t: Tables) -> DataFrame:
    return explore.facet(t.part, PART, [Condition("brand", "equals", ("Brand#1",)), Condition("type", "equals", ("SMALL", "LARGE"))], "brand", 10)


@query("""WITH f AS (SELECT p_brand, p_type, p_size, p_type IN ('SMALL', 'LARGE') AS c0, p_size >= 20 AS c1 FROM part),
l AS (SELECT 'type' AS facet, p_type AS value FROM f WHERE c1 UNION ALL SELECT 'brand', p_brand FROM f WHERE c0 AND c1
      UNION ALL SELECT 'size', p_size::VARCHAR FROM f WHERE c0),
c AS (SELECT facet, value, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY ALL)
SELECT facet, value, n, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value)::INT AS rank FROM c
QUALIFY rank <= 4""")
def multi_facet_flags(t: Tables) -> DataFrame:
    return explore.facets(t.part, PART, [Condition("type", "in", ("SMALL", "LARGE")), Condition("size", "gte", (20,))], ["type", "brand", "size"], 4)


@query("""SELECT p_partkey, b FROM (SELECT p_partkey, nullif(p_brand, 'Brand#2') AS b FROM part) WHERE b IS NULL OR b NOT IN ('Brand#1', 'Brand#3')""")
def filter_not_equals_null_inclusive(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.nullif("p_brand", F.lit("Brand#2")).alias("b"))
    return rows.where(compile_filter([Condition("b", "not_equals", ("Brand#1", "Brand#3"))], {"b": Field("b")}))


@query("""SELECT p_partkey, p_size FROM (SELECT *, CASE WHEN p_size % 7 = 0 THEN ' ' ELSE p_type END AS k FROM part) WHERE k IS NULL OR trim(k) = ''""")
def filter_is_empty(t: Tables) -> DataFrame:
    rows = t.part.withColumn("k", F.when(F.col("p_size") % 7 == 0, " ").otherwise(F.col("p_type")))
    return rows.where(compile_filter([Condition("k", "is_empty")], {"k": Field("k")})).select("p_partkey", "p_size")


@query(r"""WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE substr(c_name, 10) END AS code FROM customer)
SELECT c_custkey, code FROM x WHERE CASE WHEN regexp_full_match(trim(code), '-?[0-9]+') THEN code::BIGINT >= 700 ELSE false END""")
def filter_guarded_numeric(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).otherwise(F.substring("c_name", 10, 99)).alias("code"))
    return rows.where(compile_filter([Condition("code", "gte", ("700",))], {"code": Field("code", "number_text")}))


@query("""SELECT p_partkey FROM part WHERE starts_with(p_name, 'red') AND (contains(p_type, 'A') OR contains(p_type, 'E')) AND p_size BETWEEN 5 AND 30
AND regexp_matches(p_brand, '#1[0-9]$')""")
def filter_operators(t: Tables) -> DataFrame:
    wanted = [Condition("name", "starts_with", ("red",)), Condition("type", "contains", ("A", "E")), Condition("size", "between", (5, 30)), Condition("brand", "regex", ("#1[0-9]$",))]
    return t.part.where(compile_filter(wanted, PART)).select("p_partkey")


@query("""SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'red') AND contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#1')""")
def search_every_word(t: Tables) -> DataFrame:
    return t.part.where(search("Red brand#1", ["p_name", "p_brand", "p_type"])).select("p_partkey", "p_name")


@query("""SELECT count(*) FILTER (p_brand = 'Brand#1') AS brand_one, count(*) FILTER (p_size % 7 = 0) AS size_gap,
count(*) FILTER (p_retailprice > 950) AS dear, count(*) AS all_rows FROM part""")
def multi_count_gaps(t: Tables) -> DataFrame:
    return explore.counters(t.part, {"brand_one": F.col("p_brand") == "Brand#1", "size_gap": F.col("p_size") % 7 == 0, "dear": F.col("p_retailprice") > 950, "all_rows": F.lit(True)})


@query("""SELECT unnest([0, 1, 2, 3])::INT AS step, unnest([count(*), count(*) FILTER (o_orderstatus = 'F'), count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')),
count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 200000)]) AS n FROM orders""")
def narrowing_trail(t: Tables) -> DataFrame:
    steps = [Condition("status", "equals", ("F",)), Condition("priority", "in", ("1-URGENT", "2-HIGH")), Condition("total", "gte", (200000,))]
    return explore.trail(t.orders, ORDER, steps)


def _shape_sql(shape: str, column: str, table: str) -> str:
    return f"""WITH v AS (SELECT {column} AS value, count(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY 1),
r AS (SELECT *, {shape} AS shape, row_number() OVER (PARTITION BY {shape} ORDER BY n DESC, value) AS rank FROM v)
SELECT shape, sum(n)::BIGINT AS n_rows, count(*) AS n_values, string_agg(value, ' | ' ORDER BY rank) FILTER (rank <= 4) AS samples FROM r GROUP BY shape"""


@query(_shape_sql("regexp_extract(trim(value), '^(\\S+)', 1)", "p_name", "part"))
def shape_leading_token(t: Tables) -> DataFrame:
    return explore.shapes(t.part, "p_name", "leading_token")


@query(_shape_sql("regexp_replace(regexp_replace(regexp_replace(value, '[0-9]', '9', 'g'), '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g')", "p_brand", "part"))
def shape_character(t: Tables) -> DataFrame:
    return explore.shapes(t.part, "p_brand", "character_shape")


@query(_shape_sql("value", "o_orderpriority", "orders"))
def shape_exact(t: Tables) -> DataFrame:
    return explore.shapes(t.orders, "o_orderpriority", "exact")


@query("""WITH l AS (SELECT 'p_brand' AS field, nullif(trim(p_brand), '') AS value FROM part UNION ALL SELECT 'p_type', nullif(trim(p_type), '') FROM part
UNION ALL SELECT 'p_size', p_size::VARCHAR FROM part),
c AS (SELECT field, value, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank FROM c)
SELECT field, sum(n)::BIGINT AS present, count(*) AS distinct_values, string_agg(value || ':' || n, ' | ' ORDER BY rank) FILTER (rank <= 3) AS top_values FROM r GROUP BY field""")
def field_profile_topk(t: Tables) -> DataFrame:
    return explore.profile(t.part, ["p_brand", "p_type", "p_size"])


@query("""WITH e AS (SELECT unnest(json_keys(props)) AS key, props FROM events)
SELECT key, count(*) AS n_rows, count(nullif(trim(props->>key), '')) AS n_filled, count(DISTINCT props->>key) AS n_values FROM e GROUP BY key""")
def key_inventory(t: Tables) -> DataFrame:
    return explore.key_inventory(t.events, "props")


@query("""SELECT l_orderkey, count(*) AS n_rows, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) END AS l_linestatus,
CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS l_returnflag FROM lineitem GROUP BY 1""")
def uniform_profile(t: Tables) -> DataFrame:
    return explore.uniform(t.lineitem, "l_orderkey", ["l_linestatus", "l_returnflag"])


@query("""WITH j AS (SELECT o.*, c_mktsegment, c_nationkey FROM orders o JOIN customer c ON o_custkey = c_custkey)
SELECT 'segment' AS breakdown, c_mktsegment AS value, count(*) AS n FROM j GROUP BY 2 UNION ALL SELECT 'status', o_orderstatus, count(*) FROM j GROUP BY 2
UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM j GROUP BY 2 UNION ALL SELECT 'year', year(o_orderdate)::VARCHAR, count(*) FROM j GROUP BY 2""")
def overview_breakdowns(t: Tables) -> DataFrame:
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return explore.breakdowns(joined, {"segment": F.col("c_mktsegment"), "status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "year": F.year("o_orderdate")})


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS reasons, sum(n)::BIGINT AS n_rows FROM c GROUP BY 1""")
def reason_map_per_group(t: Tables) -> DataFrame:
    maps = explore.reason_maps(t.events, "user_id", "event_type")
    return maps.select("user_id", F.array_join(F.transform(F.map_entries("reasons"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("reasons"), "n_rows")


@query("""WITH a AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1),
b AS (SELECT s_nationkey + 7 AS nation, count(*) AS n FROM supplier GROUP BY 1)
SELECT coalesce(a.nation, b.nation) AS nation, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right FROM a FULL JOIN b ON a.nation = b.nation""")
def coverage_full_outer(t: Tables) -> DataFrame:
    left = t.customer.select(F.col("c_nationkey").alias("nation"))
    right = t.supplier.select((F.col("s_nationkey") + 7).alias("nation"))
    return explore.coverage(left, right, "nation")


@query("""WITH l AS (SELECT (p_size > 30)::INT AS f, unnest(['p_brand', 'p_type', 'p_name']) AS field, unnest([p_brand, p_type, p_name]) AS value FROM part),
v AS (SELECT field, value, count(*) AS n, sum(f) AS k FROM l GROUP BY ALL),
x AS (SELECT *, sum(n) OVER (PARTITION BY field) AS all_n, sum(k) OVER (PARTITION BY field) AS all_k FROM v),
s AS (SELECT field, sum(n) / max(all_n) AS coverage, sum(abs(k / n - all_k / all_n) * n) / sum(n) AS separation, count(*) AS distinct_values FROM x WHERE value IS NOT NULL GROUP BY field)
SELECT field, round(coverage, 4) AS coverage, round(separation, 4) AS separation, distinct_values,
round(coverage * separation / (1 + log10(distinct_values)), 4) AS score, distinct_values >= 2 AND separation >= 0.02 AS usable FROM s""")
def discriminator_scores(t: Tables) -> DataFrame:
    return explore.discriminators(t.part, ["p_brand", "p_type", "p_name"], F.col("p_size") > 30)


@query("""SELECT user_id, arg_max(event_type, k) AS event_type, max(k).event_id AS event_id FROM
(SELECT user_id, event_type, struct_pack(ts := ts, event_id := event_id) AS k FROM events) GROUP BY 1""")
def latest_per_key(t: Tables) -> DataFrame:
    return latest.latest_values(t.events, ["user_id"], ["ts", "event_id"], ["event_type"]).select("user_id", "event_type", "event_id")


@query("""SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders QUALIFY rank <= 3""")
def lateral_topk(t: Tables) -> DataFrame:
    return latest.latest_n(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3)


@query("""SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events QUALIFY before IS DISTINCT FROM event_type""")
def lag_changes(t: Tables) -> DataFrame:
    return latest.changes(t.events, "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type", "before")


@query("""WITH d AS (SELECT doc_id, md5(text) AS digest, n_chars FROM documents)
SELECT doc_id, digest, row_number() OVER (PARTITION BY digest ORDER BY n_chars DESC, doc_id)::INT AS rank,
row_number() OVER (PARTITION BY digest ORDER BY n_chars DESC, doc_id) = 1 AS survives FROM d""")
def dedupe_survivor(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.md5(F.encode("text", "utf-8")).alias("digest"), "n_chars")
    return latest.survivors(rows, "digest", [F.desc("n_chars"), F.asc("doc_id")]).select("doc_id", "digest", "rank", "survives")


@query("""WITH c AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus, lag(o_orderstatus) OVER w AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
k AS (SELECT * FROM c WHERE b IS DISTINCT FROM o_orderstatus)
SELECT o_custkey, o_orderstatus, o_orderdate AS valid_from, lead(o_orderdate) OVER w AS valid_to, lead(o_orderdate) OVER w IS NULL AS is_current FROM k WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def scd2_intervals(t: Tables) -> DataFrame:
    return latest.intervals(t.orders, "o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")


@query("""SELECT c_custkey, md5('round-1|' || c_custkey) AS draw FROM customer ORDER BY draw, c_custkey LIMIT 100""")
def seeded_sample(t: Tables) -> DataFrame:
    return latest.seeded_sample(t.customer.select("c_custkey"), "c_custkey", "round-1", 100)


@query("""SELECT doc_id, quality, toxic, row_number() OVER (PARTITION BY quality, toxic ORDER BY md5('bands|' || doc_id), doc_id)::INT AS rank FROM labels QUALIFY rank <= 20""")
def stratified_sample(t: Tables) -> DataFrame:
    return latest.stratified_sample(t.labels, ["quality", "toxic"], "doc_id", "bands", 20).select("doc_id", "quality", "toxic", "rank")


@query("""SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 50""")
def keyset_page(t: Tables) -> DataFrame:
    return latest.page_after(t.orders.select("o_orderkey", "o_orderdate"), "o_orderkey", 1000, 50)


@query("""WITH d AS (SELECT md5(concat_ws(chr(31), s_suppkey::VARCHAR, s_name, s_nationkey::VARCHAR)) AS h FROM supplier)
SELECT count(*) AS n_rows, sum(('0x' || substr(h, 1, 16))::UBIGINT::HUGEINT)::VARCHAR AS high, sum(('0x' || substr(h, 17, 16))::UBIGINT::HUGEINT)::VARCHAR AS low FROM d""")
def content_fingerprint(t: Tables) -> DataFrame:
    return latest.fingerprint(t.supplier, ["s_suppkey", "s_name", "s_nationkey"])


@query("""SELECT e.event_id, e.user_id, n.event_id AS purchase_id, n.ts AS purchase_ts FROM (SELECT * FROM events WHERE event_type = 'click') e
LEFT JOIN LATERAL (SELECT event_id, ts FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts >= e.ts ORDER BY ts LIMIT 1) n ON true""")
def asof_seek_first_ge(t: Tables) -> DataFrame:
    clicks = t.events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    buys = t.events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("purchase_ts"), F.col("event_id").alias("purchase_id"))
    return latest.seek(clicks, buys, ["user_id"], "ts", "purchase_ts", ["purchase_id"]).select("event_id", "user_id", "purchase_id", "purchase_ts")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000 UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')""")
def union_distinct_semi(t: Tables) -> DataFrame:
    ids = t.orders.where("o_totalprice > 490000").select("o_custkey").unionByName(t.orders.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").select("o_custkey"))
    return t.customer.join(ids.distinct(), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("""SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)""")
def anti_join(t: Tables) -> DataFrame:
    return t.part.join(t.lineitem.where("l_quantity > 45"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("p_partkey")


@query("""SELECT n_name, r_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total
FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def star_left_joins(t: Tables) -> DataFrame:
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy("n_name", "r_name").agg(F.countDistinct("c_custkey").alias("customers"), F.count("o_orderkey").alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("""WITH RECURSIVE d(v) AS (SELECT min(c_mktsegment) FROM customer UNION ALL SELECT (SELECT min(c_mktsegment) FROM customer WHERE c_mktsegment > v) FROM d WHERE v IS NOT NULL)
SELECT v FROM d WHERE v IS NOT NULL""")
def recursive_distinct(t: Tables) -> DataFrame:
    """Where an index would be skipped through, a distinct aggregate combines before its shuffle."""
    return t.customer.select(F.col("c_mktsegment").alias("v")).where("v IS NOT NULL").distinct()


@query("""SELECT l_returnflag, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS qty, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS statuses, count(DISTINCT l_suppkey) FILTER (l_discount > 0.05) AS suppliers, bool_or(l_tax > 0.07) AS any_high_tax
FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_quantity > 10) > 100""")
def having_conditional(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_returnflag").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("qty"), F.array_join(F.array_sort(F.collect_set("l_linestatus")), ",").alias("statuses"), F.countDistinct(F.when(F.col("l_discount") > 0.05, F.col("l_suppkey"))).alias("suppliers"), F.bool_or(F.col("l_tax") > 0.07).alias("any_high_tax"), F.count(F.when(F.col("l_quantity") > 10, 1)).alias("__n"))
    return g.where("__n > 100").drop("__n")


@query("""SELECT user_id, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS view, max(value) FILTER (event_type = 'error') AS error FROM events GROUP BY 1""")
def pivot_conditional_max(t: Tables) -> DataFrame:
    from ..sources.readers import pivot_attributes

    return pivot_attributes(t.events, ["user_id"], "event_type", "value", ["click", "view", "error"])


@query("""WITH r AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'open' WHEN o_totalprice < 50000 THEN 'small' WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE 'eligible' END AS outcome FROM orders) SELECT outcome, count(*) AS n FROM r GROUP BY 1""")
def eligibility_waterfall(t: Tables) -> DataFrame:
    return compare.waterfall(t.orders, {"open": F.col("o_orderstatus") == "P", "small": F.col("o_totalprice") < 50000, "low": F.col("o_orderpriority") == "5-LOW"})


@query("""WITH s AS (SELECT o_orderstatus, o_orderpriority, year(o_orderdate)::INT AS y, CASE WHEN o_totalprice > 250000 THEN 'high' ELSE 'low' END AS reason FROM orders),
c AS (SELECT sha256(concat_ws('|', o_orderstatus, o_orderpriority, y::VARCHAR)) AS cohort, o_orderstatus, o_orderpriority, y, reason, count(*) AS n FROM s GROUP BY ALL)
SELECT cohort, o_orderstatus, o_orderpriority, y, sum(n)::BIGINT AS members, string_agg(reason || '=' || n, ',' ORDER BY reason || '=' || n) AS reasons FROM c GROUP BY ALL""")
def signature_chunks(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("y", F.year("o_orderdate"))
    return compare.cohorts(rows, ["o_orderstatus", "o_orderpriority", "y"], F.when(F.col("o_totalprice") > 250000, "high").otherwise("low"))


@query("""WITH x AS (SELECT greatest(n_chars, 0) AS s, quality FROM labels JOIN documents USING (doc_id)),
p AS (SELECT s AS threshold, count(*) AS n, sum(quality) AS k FROM x GROUP BY 1),
c AS (SELECT threshold, sum(n) OVER w AS cn, sum(k) OVER w AS ck, sum(k) OVER () AS all_k FROM p WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))
SELECT threshold, cn::BIGINT AS n_selected, round(ck / cn, 6) AS precision, round(ck / all_k, 6) AS recall,
round((ck / cn + 1.96 * 1.96 / (2 * cn) - 1.96 * sqrt((ck / cn * (1 - ck / cn) + 1.96 * 1.96 / (4 * cn)) / cn)) / (1 + 1.96 * 1.96 / cn), 6) AS precision_low FROM c""".replace("1.96", "1.96::DOUBLE"))
def threshold_sweep_wilson(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents, "doc_id").select(F.greatest("n_chars", F.lit(0)).alias("s"), "quality")
    return compare.sweep(rows, "s", "quality")


@query(r"""WITH u AS (SELECT page_id, regexp_extract(url, '^(https?)://([^/?#]+)(/[^?#]*)?(?:\?([^#]*))?(?:#(.*))?$', ['scheme', 'host', 'path', 'query', 'fragment']) AS g FROM pages)
SELECT page_id, g.scheme AS scheme, lower(regexp_replace(g.host, '^(www|m)\.', '')) AS host, nullif(g.path, '') AS path, nullif(g.query, '') AS query, nullif(g.fragment, '') AS fragment FROM u""")
def regex_grammar_parse(t: Tables) -> DataFrame:
    grammar = r"^(https?)://([^/?#]+)(/[^?#]*)?(?:\?([^#]*))?(?:#(.*))?$"
    part = lambda i: F.regexp_extract("url", grammar, i)
    return t.pages.select("page_id", part(1).alias("scheme"), F.lower(F.regexp_replace(part(2), r"^(www|m)\.", "")).alias("host"), *(F.nullif(part(i), F.lit("")).alias(n) for i, n in ((3, "path"), (4, "query"), (5, "fragment"))))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity::DECIMAL(18,6) * 0.735499::DECIMAL(18,6), 1)::DOUBLE AS kw, round(l_extendedprice::DECIMAL(18,6) * 0.1::DECIMAL(18,6), 0)::DOUBLE AS tenth FROM lineitem""")
def unit_scaling(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.scaled(F.col("l_quantity"), "0.735499", 1).cast("double").alias("kw"), text.scaled(F.col("l_extendedprice"), "0.1", 0).cast("double").alias("tenth"))


@query("""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN strftime(o_orderdate, '%Y%m') WHEN 2 THEN strftime(o_orderdate, '%Y') ELSE 'n/a' END AS raw, o_orderdate FROM orders)
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN last_day(o_orderdate::DATE) WHEN 2 THEN make_date(year(o_orderdate), 12, 31) END AS value,
CASE o_orderkey % 4 WHEN 0 THEN 'day' WHEN 1 THEN 'month' WHEN 2 THEN 'year' END AS precision FROM r""")
def partial_dates(t: Tables) -> DataFrame:
    form = F.col("o_orderkey") % 4
    raw = F.when(form == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(form == 1, F.date_format("o_orderdate", "yyyyMM")).when(form == 2, F.date_format("o_orderdate", "yyyy")).otherwise("n/a")
    return t.orders.select("o_orderkey", text.partial_date(raw).alias("d")).select("o_orderkey", "d.value", "d.precision")


@query("""SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def windowed_counts(t: Tables) -> DataFrame:
    """The batch form of the streaming count by event-time window."""
    from ..streaming.refresh import windowed_counts as counts

    return counts(t.events, "ts", ["event_type"], "1 day", "1 hour")
