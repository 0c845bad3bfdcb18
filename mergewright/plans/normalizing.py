"""Queries that normalise rows by rules, and further joins, calibrations and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import compare, normalize
from ..operators.normalize import Proposal
from .registry import Tables, query

#: How the query's rule tables come from the catalogue: colours and things by name, kinds by type, all derived from rows.
NORMALIZED = """WITH w AS (SELECT p_partkey, p_name, p_brand, p_type, p_size, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, try_cast(substr(p_brand, 7) AS INT) AS code FROM part),
known AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS thing FROM part WHERE p_size <= 2),
s AS (SELECT p_partkey, CASE WHEN k.thing IS NOT NULL THEN upper(w.b) END AS family, CASE WHEN k.thing IS NULL THEN w.b END AS cand,
 CASE WHEN code > 20 THEN NULL ELSE 'brand ' || code END AS brand, CASE WHEN code > 20 THEN 'brand_unknown' END AS reason, CASE WHEN p_size > 0 THEN p_size * 10 END AS size_mm FROM w LEFT JOIN known k ON k.thing = w.b)"""


def _normalized(t: Tables) -> DataFrame:
    things = t.part.where("p_size <= 2").select(F.split("p_name", " ")[1].alias("term")).distinct().select("term", F.upper("term").alias("value"), F.concat(F.lit("FAM-"), "term").alias("rule_id"))
    code = text.guarded_int(F.substring("p_brand", 7, 9))

    def family(df: DataFrame):
        hit = normalize.whole_words(df, ["p_partkey"], "p_name", things)
        return hit, [Proposal("family", value=F.col("rule_value"), candidate=F.when(F.col("rule_value").isNull(), F.split("p_name", " ")[1]), rule_id=F.col("hit_rule"))]

    def brand(df: DataFrame):
        return df, [Proposal("brand", value=F.when(code <= 20, F.concat_ws(" ", F.lit("brand"), code.cast("string"))), reason=F.when(code > 20, "brand_unknown"))]

    def measures(df: DataFrame):
        return df, [Proposal("size_mm", value=text.measure(F.col("p_size").cast("string")) * 10)]

    return normalize.run(t.part, [("20 family", family), ("30 brand", brand), ("36 measures", measures)])


@query(NORMALIZED + """SELECT p_partkey, family, brand, size_mm::VARCHAR AS size_mm, cand AS family_candidate, coalesce(reason, '') AS reasons,
CASE WHEN reason IS NOT NULL THEN 'review' WHEN cand IS NOT NULL THEN 'provisional' ELSE 'resolved' END AS status,
CASE WHEN reason IS NOT NULL THEN 0.55 WHEN cand IS NOT NULL THEN 0.80 ELSE 0.95 END::DOUBLE AS confidence FROM s""")
def normalise_status(t: Tables) -> DataFrame:
    n = lambda f: F.try_element_at("normalized", F.lit(f)).alias(f)
    return _normalized(t).select("p_partkey", n("family"), n("brand"), n("size_mm"), F.try_element_at("candidates", F.lit("family")).alias("family_candidate"), F.array_join("reasons", ",").alias("reasons"), "status", "confidence")


@query(NORMALIZED + """, l AS (SELECT p_partkey, 1 AS i, '20 family' AS stage, 'family' AS field, family AS after FROM s UNION ALL SELECT p_partkey, 2, '30 brand', 'brand', brand FROM s UNION ALL SELECT p_partkey, 3, '36 measures', 'size_mm', size_mm::VARCHAR FROM s)
SELECT p_partkey, (row_number() OVER (PARTITION BY p_partkey ORDER BY i) - 1)::INT AS sequence, stage, field, after FROM l WHERE after IS NOT NULL""")
def normalise_trace(t: Tables) -> DataFrame:
    return _normalized(t).select("p_partkey", F.posexplode("trace").alias("sequence", "e")).select("p_partkey", "sequence", "e.stage", "e.field", "e.after")


@query("""WITH r AS (SELECT p_type AS term, p_brand AS scope, min(p_name) AS value FROM part WHERE p_size = 7 GROUP BY ALL), g AS (SELECT 'SMALL' AS term, 'anything' AS value)
SELECT p_partkey, coalesce(r.value, g.value) AS value FROM part LEFT JOIN r ON p_type = r.term AND p_brand = r.scope LEFT JOIN g ON p_type = g.term""")
def dictionary_scoped(t: Tables) -> DataFrame:
    scoped = t.part.where("p_size = 7").groupBy(F.col("p_type").alias("term"), F.col("p_brand").alias("scope")).agg(F.min("p_name").alias("value"))
    general = t.part.where("p_type = 'SMALL'").select(F.col("p_type").alias("term"), F.lit(None).cast("string").alias("scope"), F.lit("anything").alias("value")).distinct()
    rules = scoped.unionByName(general).withColumn("rule_id", F.concat_ws("/", "term", "scope"))
    return normalize.dictionary(t.part, "p_type", rules, scope=F.col("p_brand")).select("p_partkey", F.col("rule_value").alias("value"))


@query(NORMALIZED + """SELECT s.p_partkey, CASE WHEN p_brand = 'Brand#22' THEN 'REVIEWED' WHEN p_type = 'SMALL' THEN NULL ELSE family END AS family,
(CASE WHEN p_brand = 'Brand#22' OR p_type = 'SMALL' THEN 0 ELSE (reason IS NOT NULL)::INT END)::INT AS n_reasons FROM s JOIN part USING (p_partkey)""")
def record_policies(t: Tables) -> DataFrame:
    done = normalize.policies(_normalized(t), [("b-small", {"p_type": "SMALL"}, {"family": None}), ("a-brand", {"p_brand": "Brand#22"}, {"family": "REVIEWED"})])
    return done.select("p_partkey", F.try_element_at("normalized", F.lit("family")).alias("family"), F.size("reasons").alias("n_reasons"))


@query("""WITH b AS (SELECT (n_chars // 1000)::BIGINT AS band, quality, 1.0 / (1 + toxic) AS w FROM labels JOIN documents USING (doc_id))
SELECT band, count(*) AS n, sum(quality)::BIGINT AS k, round(sum(w)::DOUBLE * sum(w)::DOUBLE / sum(w * w)::DOUBLE, 6) AS effective_n FROM b GROUP BY 1""")
def calibration_bands(t: Tables) -> DataFrame:
    """Rows, accepted rows and Kish's effective size of weighted rows for each band of a score."""
    w = 1.0 / (1 + F.col("toxic"))
    rows = t.labels.join(t.documents, "doc_id").select(F.floor(F.col("n_chars") / 1000).alias("band"), "quality", w.alias("w"))
    return rows.groupBy("band").agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("k"), F.round(F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w")), 6).alias("effective_n"))


@query("""SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' OR c_nationkey IS NULL OR c_nationkey = o_orderkey % 25""")
def disjunctive_identity_join(t: Tables) -> DataFrame:
    """One key equal, and any of several other facts: an equi join with a residual, never a join on OR."""
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.where("c_mktsegment = 'MACHINERY' OR c_nationkey IS NULL OR c_nationkey = o_orderkey % 25").select("o_orderkey", "c_custkey")


@query("""WITH r AS (SELECT p_brand AS k1, (p_size // 10)::VARCHAR AS k2, min(p_partkey) AS rule FROM part WHERE p_type = 'LARGE' GROUP BY ALL)
SELECT p_partkey, rule FROM part LEFT JOIN r ON p_brand = k1 AND (p_size // 10)::VARCHAR = k2""")
def computed_key_join(t: Tables) -> DataFrame:
    decade = F.floor(F.col("p_size") / 10).cast("string")
    rules = t.part.where("p_type = 'LARGE'").groupBy(F.col("p_brand").alias("k1"), decade.alias("k2")).agg(F.min("p_partkey").alias("rule"))
    keyed = t.part.select("p_partkey", F.col("p_brand").alias("k1"), decade.alias("k2"))
    return keyed.join(rules, ["k1", "k2"], "left").select("p_partkey", "rule")


@query("""SELECT o_orderpriority, count(*) AS n_rows, sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus = 'F')::DOUBLE AS done, sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus <> 'F')::DOUBLE AS open FROM orders GROUP BY 1""")
def progress_rollup(t: Tables) -> DataFrame:
    price, done = F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderstatus") == "F"
    return t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n_rows"), F.sum(F.when(done, price)).cast("double").alias("done"), F.sum(F.when(~done, price)).cast("double").alias("open"))


@query("""WITH c AS (SELECT lang, count(*) AS n, count(*) FILTER (source IN (SELECT s_name FROM supplier) OR source LIKE 'src1%') AS covered FROM documents GROUP BY 1)
SELECT lang, n, covered, round(covered / n, 6) AS share, round(sum(covered) OVER () / sum(n) OVER (), 6) AS weighted_share FROM c""")
def weighted_coverage(t: Tables) -> DataFrame:
    """Coverage of each group and, weighted by rows, of all."""
    names = t.supplier.select(F.col("s_name").alias("source"), F.lit(True).alias("named")).distinct()
    covered = F.coalesce(F.col("named"), F.col("source").startswith("src1"))
    groups = t.documents.join(names, "source", "left").groupBy("lang").agg(F.count("*").alias("n"), F.count(F.when(covered, 1)).alias("covered"))
    whole = groups.agg((F.sum("covered") / F.sum("n")).alias("w"))
    return groups.join(F.broadcast(whole)).select("lang", "n", "covered", F.round(F.col("covered") / F.col("n"), 6).alias("share"), F.round("w", 6).alias("weighted_share"))


@query("""WITH t AS (SELECT DISTINCT conv_id, role FROM conversations), m AS (SELECT conv_id, count(*) AS turns, sum(length(text))::BIGINT AS chars, max(turn) AS last_turn, arg_max(role, turn) AS last_role FROM conversations GROUP BY 1)
SELECT m.conv_id, turns, chars, last_turn, last_role, (SELECT string_agg(role, ',' ORDER BY role) FROM t WHERE t.conv_id = m.conv_id) AS roles FROM m""")
def conversation_heads(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"), F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


@query("""WITH o AS (SELECT l_partkey, bool_or(l_returnflag = 'A') AS any_ok, bool_or(l_discount > 0.09) AS failed FROM lineitem GROUP BY 1) SELECT l_partkey, any_ok AND NOT failed AS accepted FROM o""")
def non_degrading_acceptance(t: Tables) -> DataFrame:
    """A change is accepted where some of its rows resolve and none fails."""
    g = t.lineitem.groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "A").alias("some"), F.bool_or(F.col("l_discount") > 0.09).alias("failed"))
    return g.select("l_partkey", (F.col("some") & ~F.col("failed")).alias("accepted"))


@query("""WITH m AS (SELECT c_nationkey, max(o_orderdate) FILTER (o_orderdate <= TIMESTAMP '1998-06-30') AS latest FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT c_nationkey, coalesce(latest, TIMESTAMP '1998-06-30') AS snapshot FROM m""")
def snapshot_dates(t: Tables) -> DataFrame:
    load = F.lit("1998-06-30").cast(t.orders.schema["o_orderdate"].dataType)
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_nationkey").agg(F.coalesce(F.max(F.when(F.col("o_orderdate") <= load, F.col("o_orderdate"))), load).alias("snapshot"))


@query("""WITH x AS (SELECT p_name, regexp_extract_all(p_brand || '-' || p_size, '[0-9]+') AS g FROM part) SELECT p_name, array_to_string(g, '/') AS series, count(*) AS n FROM x GROUP BY ALL""")
def digit_series(t: Tables) -> DataFrame:
    groups = F.regexp_extract_all(F.concat_ws("-", "p_brand", F.col("p_size").cast("string")), F.lit("([0-9]+)"), F.lit(1))
    return t.part.select("p_name", F.array_join(groups, "/").alias("series")).groupBy("p_name", "series").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') AS k, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS spelling FROM part),
c AS (SELECT k, spelling, count(*) AS n FROM x GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, spelling) AS i, count(*) OVER (PARTITION BY k) AS spellings FROM c) SELECT k, spelling AS preferred, n, spellings FROM r WHERE i = 1""")
def preferred_spelling(t: Tables) -> DataFrame:
    """Of the spellings of one compact key the most frequent."""
    x = t.part.select(text.compact(F.col("p_name")).alias("k"), F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("spelling"))
    counted = x.groupBy("k", "spelling").agg(F.count("*").alias("n"))
    best = counted.groupBy("k").agg(F.min(F.struct((-F.col("n")).alias("m"), "spelling")).alias("b"), F.count("*").alias("spellings"))
    return best.select("k", F.col("b.spelling").alias("preferred"), (-F.col("b.m")).alias("n"), "spellings")


@query("""WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 10 GROUP BY 1), x AS (SELECT l_suppkey, count(*) AS a, count(DISTINCT l_partkey) AS p FROM lineitem GROUP BY 1)
SELECT x.l_suppkey, a AS n_all, coalesce(n, 0) AS n_block, p AS n_parts FROM x LEFT JOIN c ON x.l_suppkey = c.l_suppkey WHERE coalesce(n, 0) >= 25 OR p >= 250""")
def repair_cohorts(t: Tables) -> DataFrame:
    block = F.count(F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") < 10), 1))
    g = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n_all"), block.alias("n_block"), F.countDistinct("l_partkey").alias("n_parts"))
    return g.where("n_block >= 25 OR n_parts >= 250")


@query("""WITH RECURSIVE t AS (SELECT doc_id AS node, md5(text) AS token FROM documents), d AS (SELECT DISTINCT token FROM t JOIN labels ON node = doc_id WHERE toxic = 1)
SELECT node AS doc_id FROM t WHERE token NOT IN (SELECT token FROM d)""")
def holdout_without_leaks(t: Tables) -> DataFrame:
    """Documents no component of which touches the development set (here: toxic ones): components over equal texts."""
    from ..sources.shared import stored

    tokens = t.documents.select("doc_id", F.md5(F.encode("text", "utf-8")).alias("token"))
    parts = compare.leakage_components(tokens, "doc_id", "token", stored)
    touched = parts.join(t.labels.where("toxic = 1").select("doc_id"), "doc_id").select("component").distinct()
    return parts.join(touched, "component", "left_anti").select("doc_id")
