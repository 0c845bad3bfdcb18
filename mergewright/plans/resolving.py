"""Queries that match, merge, learn and govern."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import compare, govern, learn, match, merge
from ..sources import readers
from .matching import like_sql
from .registry import Tables, query

RULES = """WITH k AS (SELECT p_brand, p_type, CASE WHEN p_size > 25 THEN 'big' ELSE 'little' END AS band FROM part),
c AS (SELECT p_brand, p_type, band AS value, count(*) AS n FROM k GROUP BY ALL),
t AS (SELECT p_brand, p_type, sum(n) AS total, max(n) AS support FROM c GROUP BY ALL),
r AS (SELECT c.p_brand, c.p_type, total::BIGINT AS total, support, min(value) AS value, support / total AS agreement FROM c JOIN t ON c.p_brand = t.p_brand AND c.p_type = t.p_type AND n = support
      GROUP BY ALL HAVING support >= 5 AND support / total >= 0.6)"""


def _banded(t: Tables) -> DataFrame:
    return t.part.withColumn("band", F.when(F.col("p_size") > 25, "big").otherwise("little"))


def _rules(t: Tables) -> DataFrame:
    return learn.majority_rules(_banded(t), ["p_brand", "p_type"], "band", "SIZE", 5, 0.6)


@query(RULES + """SELECT p_brand, p_type, value, support, total, round(agreement, 6) AS agreement,
'SIZE-' || substr(sha256(concat_ws(chr(31), 'SIZE', p_brand, p_type, value)), 1, 12) AS rule_id FROM r""")
def learned_majority_rules(t: Tables) -> DataFrame:
    return _rules(t).select("p_brand", "p_type", "value", "support", "total", F.round("agreement", 6).alias("agreement"), "rule_id")


@query(RULES + """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN value ELSE CASE WHEN p_size > 25 THEN 'big' ELSE 'little' END END AS band,
CASE WHEN p_partkey % 3 = 0 AND value IS NOT NULL THEN 'SIZE-' || substr(sha256(concat_ws(chr(31), 'SIZE', part.p_brand, part.p_type, value)), 1, 12) END AS filled_by
FROM part LEFT JOIN r ON part.p_brand = r.p_brand AND part.p_type = r.p_type""")
def apply_rules_fill(t: Tables) -> DataFrame:
    gaps = _banded(t).select("p_partkey", "p_brand", "p_type", F.when(F.col("p_partkey") % 3 != 0, F.col("band")).alias("band"))
    return learn.apply_rules(gaps, _rules(t), ["p_brand", "p_type"], "band").select("p_partkey", "band", "filled_by")


@query(RULES + """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN value = 'big' THEN NULL ELSE value END ELSE CASE WHEN p_size > 25 THEN 'big' ELSE 'little' END END AS band
FROM part LEFT JOIN r ON part.p_brand = r.p_brand AND part.p_type = r.p_type""")
def rules_retracted(t: Tables) -> DataFrame:
    gaps = _banded(t).select("p_partkey", "p_brand", "p_type", F.when(F.col("p_partkey") % 3 != 0, F.col("band")).alias("band"))
    rules = _rules(t)
    return learn.retract(learn.apply_rules(gaps, rules, ["p_brand", "p_type"], "band"), rules.where("value = 'big'"), "band").select("p_partkey", "band")


@query("""WITH n AS (SELECT *, nullif(p_type, 'SMALL') AS t FROM part WHERE p_brand IN ('Brand#1', 'Brand#2'))
SELECT count(*) AS matched, count(*) FILTER (t IS NULL) AS would_fill, count(*) FILTER (t = 'ECONOMY') AS already, count(*) FILTER (t <> 'ECONOMY') AS would_overwrite FROM n""")
def rule_preview_overwrite(t: Tables) -> DataFrame:
    rows = t.part.withColumn("t", F.nullif("p_type", F.lit("SMALL")))
    return learn.preview(rows, F.col("p_brand").isin("Brand#1", "Brand#2"), "t", "ECONOMY")


@query("""WITH b AS (SELECT substr(p_name, 1, 3) AS prefix, count(*) AS n, sum((p_size > 30)::INT)::BIGINT AS k FROM part WHERE length(p_name) >= 3 GROUP BY 1), a AS (SELECT sum(k) AS all_k FROM b)
SELECT prefix, n, k, round(k / all_k * (1 - k / all_k), 6) AS rank_score FROM b, a WHERE n >= 20""")
def prefix_patterns(t: Tables) -> DataFrame:
    return learn.prefix_patterns(t.part, "p_name", F.col("p_size") > 30, 3, 20)


@query("""WITH x AS (SELECT l_suppkey, l_linenumber, CASE WHEN l_quantity > 48 THEN l_returnflag END AS anchor FROM lineitem)
SELECT l_suppkey, l_linenumber, min(anchor) AS proposed, count(anchor) AS anchors, count(*) FILTER (anchor IS NULL) AS open_rows FROM x GROUP BY ALL
HAVING count(anchor) >= 2 AND count(DISTINCT anchor) = 1 AND count(*) FILTER (anchor IS NULL) > 0""")
def proposals_unique_anchor(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_suppkey", "l_linenumber", F.when(F.col("l_quantity") > 48, F.col("l_returnflag")).alias("anchor"))
    return learn.proposals(rows, ["l_suppkey", "l_linenumber"], "anchor")


OBSERVATIONS = """WITH o AS (
SELECT c_custkey AS entity, 'segment' AS field, c_mktsegment AS value, 'registry' AS source, DATE '2024-01-01' AS observed_on FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'nation', c_nationkey::VARCHAR, 'registry', DATE '2024-01-01' FROM customer
UNION ALL SELECT c_custkey, 'segment', lower(c_mktsegment), 'provider', DATE '2024-03-01' FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT c_custkey, 'nation', (c_nationkey + 1)::VARCHAR, 'provider', DATE '2024-03-01' FROM customer
UNION ALL SELECT c_custkey, 'segment', 'REVIEWED', 'correction', DATE '2023-06-01' FROM customer WHERE c_custkey % 10 = 0)"""
WINNERS = """, r AS (SELECT *, row_number() OVER (PARTITION BY entity, field ORDER BY CASE source WHEN 'correction' THEN 110 WHEN 'registry' THEN 60 WHEN 'provider' THEN 50 ELSE 0 END DESC, observed_on DESC, source, value) AS k,
count(*) OVER (PARTITION BY entity, field) AS n_observations FROM o)"""
RANKS = {"correction": 110, "registry": 60, "provider": 50}


def _observations(t: Tables) -> DataFrame:
    day = lambda d: F.lit(d).cast("date")
    c = t.customer
    registry = merge.observe(c, F.col("c_custkey"), "registry", day("2024-01-01"), {"segment": F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")), "nation": F.col("c_nationkey")})
    provider = merge.observe(c, F.col("c_custkey"), "provider", day("2024-03-01"), {"segment": F.when(F.col("c_custkey") % 3 != 0, F.lower("c_mktsegment")), "nation": F.col("c_nationkey") + 1})
    correction = merge.observe(c.where("c_custkey % 10 = 0"), F.col("c_custkey"), "correction", day("2023-06-01"), {"segment": F.lit("REVIEWED")})
    return registry.unionByName(provider).unionByName(correction)


@query(OBSERVATIONS + WINNERS + """SELECT r.entity, r.field, r.value, r.source, r.observed_on, r.n_observations,
(SELECT coalesce(string_agg(DISTINCT x.value, ',' ORDER BY x.value), '') FROM o x WHERE x.entity = r.entity AND x.field = r.field AND x.value <> r.value) AS alternatives FROM r WHERE k = 1""")
def merge_survivorship(t: Tables) -> DataFrame:
    return merge.survivors(_observations(t), RANKS).withColumn("alternatives", F.array_join("alternatives", ","))


@query(OBSERVATIONS.replace("UNION ALL SELECT c_custkey, 'segment', 'REVIEWED', 'correction', DATE '2023-06-01' FROM customer WHERE c_custkey % 10 = 0)", "UNION ALL SELECT c_custkey, 'segment', 'REVIEWED', 'correction', DATE '2023-06-01' FROM customer WHERE c_custkey % 10 = 0 AND c_custkey % 20 <> 0)") + WINNERS + """SELECT entity, field, value, source FROM r WHERE k = 1""")
def retract_fallback(t: Tables) -> DataFrame:
    withdrawn = t.customer.where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("entity"), F.lit("segment").alias("field"), F.lit("correction").alias("source"))
    return merge.survivors(merge.retract(_observations(t), withdrawn), RANKS).select("entity", "field", "value", "source")


@query(OBSERVATIONS + WINNERS + """SELECT entity, max(value) FILTER (field = 'segment') AS segment, max(value) FILTER (field = 'nation') AS nation, string_agg(field || '=' || source, ',' ORDER BY field) AS field_sources FROM r WHERE k = 1 GROUP BY 1""")
def golden_records(t: Tables) -> DataFrame:
    gold = merge.golden(merge.survivors(_observations(t), RANKS), ["segment", "nation"])
    return gold.withColumn("field_sources", F.array_join(F.transform(F.map_entries("field_sources"), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))


@query("""WITH n AS (SELECT c_custkey + 100 AS c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer)
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN n.c_name ELSE o.c_name END AS c_name, coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment,
CASE WHEN o.c_custkey IS NULL THEN 'inserted' WHEN n.c_custkey IS NOT NULL AND n.c_mktsegment IS DISTINCT FROM o.c_mktsegment THEN 'updated' ELSE 'unchanged' END AS change
FROM customer o FULL JOIN n ON o.c_custkey = n.c_custkey""")
def upsert_changed_only(t: Tables) -> DataFrame:
    old = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    new = t.customer.select((F.col("c_custkey") + 100).alias("c_custkey"), "c_name", F.when(F.col("c_custkey") % 4 == 0, "NEW").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return merge.upsert(old, new, "c_custkey", protected=["c_name"])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 15 = 0 THEN 'second' WHEN c_custkey % 5 = 0 THEN 'first' ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def overlay_layers(t: Tables) -> DataFrame:
    base = t.customer.select("c_custkey", "c_mktsegment")
    layer = lambda n, v: base.where(f"c_custkey % {n} = 0").withColumn("c_mktsegment", F.lit(v))
    return merge.overlay(base, "c_custkey", ["c_mktsegment"], layer(5, "first"), layer(15, "second"))


QUERY_PARTS = """WITH q AS (SELECT p_partkey AS q_id, p_name AS q_name, p_brand AS q_brand, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size + (p_partkey % 3)::INT END AS q_size, p_type AS q_type FROM part),
c AS (SELECT min(p_partkey) AS c_id, p_name AS c_name, p_brand AS c_brand, min(p_size) AS c_size, min(p_type) AS c_type FROM part GROUP BY p_name, p_brand),
n AS (SELECT a.p_name AS q_name, b.p_name AS c_name, list_distinct(string_split(a.p_name, ' ')) AS ta, list_distinct(string_split(b.p_name, ' ')) AS tb, replace(a.p_name, ' ', '') AS ea, replace(b.p_name, ' ', '') AS eb FROM (SELECT DISTINCT p_name FROM part) a, (SELECT DISTINCT p_name FROM part) b),
e AS (SELECT *, """ + like_sql("ea", "eb") + """ AS edit, len(list_intersect(ta, tb)) / (len(ta) + len(tb) - len(list_intersect(ta, tb))) AS jac FROM n),
l AS (SELECT q_name, c_name, round(CASE WHEN len(ta) <= 1 AND len(tb) <= 1 THEN edit ELSE 0.65::DOUBLE * edit + 0.35::DOUBLE * jac END, 6) AS text_score FROM e),
s AS (SELECT * FROM q JOIN l USING (q_name) JOIN c ON q_brand = c_brand AND l.c_name = c.c_name),
v AS (SELECT *, CASE WHEN q_size IS NULL OR c_size IS NULL THEN 'missing' WHEN q_size = c_size THEN 'matched' WHEN abs(q_size - c_size) <= 2 THEN 'unverified' ELSE 'conflicting' END AS size_state,
 CASE WHEN q_type = c_type THEN 'matched' ELSE 'conflicting' END AS type_state FROM s),
sc AS (SELECT *, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, text_score + (CASE size_state WHEN 'matched' THEN 0.05 WHEN 'unverified' THEN -0.05 WHEN 'conflicting' THEN -0.25 ELSE 0 END::DOUBLE + CASE type_state WHEN 'matched' THEN 0.05 ELSE -0.15 END::DOUBLE))), 6) AS score FROM v),
rk AS (SELECT *, row_number() OVER w AS rank, round(score - coalesce(lead(score) OVER w, 0), 6) AS margin, count(*) OVER (PARTITION BY q_id) AS n_candidates, (size_state = 'conflicting')::INT + (type_state = 'conflicting')::INT AS conflicts FROM sc WINDOW w AS (PARTITION BY q_id ORDER BY score DESC, c_id))"""


def _ranked(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Every part as a query against all of the catalogue of distinct (name, brand) that has its brand, ranked once for queries
    alike, and the parts that each of these stands for."""
    size = F.when(F.col("p_partkey") % 4 != 0, F.col("p_size") + (F.col("p_partkey") % 3).cast("int"))
    every = t.part.select(F.col("p_partkey").alias("q_id"), F.col("p_name").alias("q_name"), F.col("p_brand").alias("q_brand"), size.alias("q_size"), F.col("p_type").alias("q_type"))
    q, members = match.distinct_queries(every, "q_id", ["q_name", "q_brand", "q_size", "q_type"])
    c = t.part.groupBy(F.col("p_name").alias("c_name"), F.col("p_brand").alias("c_brand")).agg(F.min("p_partkey").alias("c_id"), F.min("p_size").alias("c_size"), F.min("p_type").alias("c_type"))
    brands = [(F.col("q_brand"), F.col("c_brand"))]
    names = match.block(q.select("q_name", "q_brand").distinct(), c.select("c_name", "c_brand"), brands)
    pairs = match.block(q, c, brands).join(match.label_similarity(names, "q_name", "c_name"), ["q_name", "c_name"])
    tests = [match.evidence("size", F.col("q_size"), F.col("c_size"), 2, 0.05, -0.05, -0.25), match.equal_evidence("type", F.col("q_type"), F.col("c_type"), 0.05, -0.15)]
    return match.rank(match.score(pairs, tests), "q_id", "c_id"), members


def _of_each(decide, t: Tables) -> DataFrame:
    """What `decide` finds of the ranked candidates, for every part."""
    ranked, members = _ranked(t)
    return match.of_members(decide(ranked), members, "q_id")


@query(QUERY_PARTS + "SELECT q_id, c_id, text_score, score, rank::INT AS rank, margin, n_candidates FROM rk WHERE rank <= 3")
def candidate_scoring_topk(t: Tables) -> DataFrame:
    return _of_each(lambda x: x.where("rank <= 3").select("q_id", "c_id", "text_score", "score", "rank", "margin", "n_candidates"), t)


@query(QUERY_PARTS + """SELECT q_id, c_id AS top_reference, score, margin, n_candidates, CASE WHEN conflicts > 0 THEN 'review_conflict' WHEN n_candidates > 1 AND margin < 0.08 THEN 'review_margin' WHEN score >= 0.90 THEN 'resolved' WHEN score >= 0.55 THEN 'provisional' ELSE 'rejected' END AS route FROM rk WHERE rank = 1""")
def route_states(t: Tables) -> DataFrame:
    return _of_each(lambda x: match.route(x, "q_id", "c_id").drop("confidence"), t)


@query(QUERY_PARTS + """, g AS (SELECT q_id, count(*) FILTER (score >= 0.55 AND conflicts = 0) AS n_plausible, max(score) FILTER (score >= 0.55 AND conflicts = 0) AS best FROM rk GROUP BY 1)
SELECT q_id, n_plausible, CASE WHEN n_plausible = 0 THEN 'none' WHEN n_plausible > 1 THEN 'several' WHEN best >= 0.90 THEN 'resolved' ELSE 'one_unconfirmed' END AS state FROM g""")
def match_state_buckets(t: Tables) -> DataFrame:
    return _of_each(lambda x: match.states(x, "q_id"), t)


@query(QUERY_PARTS + """, g AS (SELECT q_id, count(*) AS n_plausible, count(DISTINCT c_size) AS a, count(DISTINCT c_type) AS b, count(DISTINCT c_name) AS d FROM rk WHERE score >= 0.55 AND conflicts = 0 GROUP BY 1 HAVING count(*) > 1)
SELECT q_id, n_plausible, concat_ws(',', CASE WHEN a > 1 THEN 'c_size' END, CASE WHEN b > 1 THEN 'c_type' END, CASE WHEN d > 1 THEN 'c_name' END) AS separating FROM g""")
def separating_fields(t: Tables) -> DataFrame:
    return _of_each(lambda x: match.separating(x, "q_id", ["c_size", "c_type", "c_name"]), t)


@query(QUERY_PARTS + """SELECT q_id, CASE WHEN size_state = 'conflicting' THEN 'size' WHEN type_state = 'conflicting' THEN 'type' WHEN text_score < 0.9 THEN 'text' ELSE 'none' END AS blocker FROM rk WHERE rank = 1""")
def blocker_classes(t: Tables) -> DataFrame:
    has = lambda n: F.array_contains("conflicting", n)
    blocker = F.coalesce(match.first_blocker({"size": has("size"), "type": has("type"), "text": F.col("text_score") < 0.9}), F.lit("none"))
    return _of_each(lambda x: x.where("rank = 1").select("q_id", blocker.alias("blocker")), t)


@query("""WITH n AS (SELECT DISTINCT p_name FROM part)
SELECT a.p_name AS a, b.p_name AS b, round(1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)), 6) AS similarity FROM n a JOIN n b ON split_part(a.p_name, ' ', 2) = split_part(b.p_name, ' ', 2) AND a.p_name < b.p_name""")
def levenshtein_similarity(t: Tables) -> DataFrame:
    n = t.part.select(F.col("p_name").alias("a"), F.split("p_name", " ")[1].alias("k")).distinct()
    pairs = n.join(n.withColumnRenamed("a", "b"), "k").where("a < b")
    return pairs.select("a", "b", F.round(text.edit_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("""WITH n AS (SELECT DISTINCT p_name FROM part)
SELECT a.p_name AS a, b.p_name AS b, round(1 - damerau_levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)), 6) AS similarity FROM n a JOIN n b ON split_part(a.p_name, ' ', 2) = split_part(b.p_name, ' ', 2) AND a.p_name < b.p_name""")
def osa_similarity(t: Tables) -> DataFrame:
    n = t.part.select(F.col("p_name").alias("a"), F.split("p_name", " ")[1].alias("k")).distinct()
    pairs = n.join(n.withColumnRenamed("a", "b"), "k").where("a < b").select("a", "b")
    return pairs.select("a", "b", F.round(text.osa_similarity("a", "b"), 6).alias("similarity"))


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part),
g AS (SELECT word, regexp_replace(upper(word), '[^A-Z]', '', 'g') AS t FROM w),
x AS (SELECT word, t, translate(t, 'BPFVCKQGXSZDTMNLRJWY', 'PPFFKKKKKSSTTNNLRIVI') AS m FROM g),
y AS (SELECT word, t, substr(m, 1, 1) || regexp_replace(substr(m, 2), '[AEIOUH]', '', 'g') AS k FROM x)
SELECT word, CASE WHEN length(t) >= 3 THEN array_to_string(list_filter(string_split(k, ''), lambda c, i: i = 1 OR c <> k[i - 1]), '') END AS key FROM y""")
def phonetic_keys(t: Tables) -> DataFrame:
    words = t.part.select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return words.select("word", text.phonetic(F.col("word")).alias("key"))


@query("""WITH a AS (SELECT doc_id, lang, text FROM documents), tk AS (SELECT doc_id, list_distinct(list_filter(string_split(trim(regexp_replace(upper(text), '[^A-Z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS t FROM a),
b AS (SELECT item_id, list_distinct(list_filter(string_split(trim(regexp_replace(upper(text), '[^A-Z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS t FROM benchmark),
ub AS (SELECT item_id, len(t) AS n, unnest(t) AS w FROM b), ud AS (SELECT doc_id, len(t) AS n, unnest(t) AS w FROM tk),
i AS (SELECT doc_id, item_id, ud.n AS na, ub.n AS nb, count(*) AS c FROM ud JOIN ub USING (w) WHERE length(w) >= 9 GROUP BY ALL)
SELECT doc_id, item_id, c AS shared_long_words FROM i WHERE c >= 5""")
def shared_rare_words(t: Tables) -> DataFrame:
    """Documents and benchmark items that share long words: an equi join on words, counted by pair."""
    words = lambda df, key: df.select(key, F.explode(text.tokens(F.col("text"))).alias("w")).where(F.length("w") >= 9)
    shared = words(t.documents, "doc_id").join(words(t.benchmark, "item_id"), "w").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared_long_words"))
    return shared.where("shared_long_words >= 5")


@query("""WITH d AS (SELECT doc_id, list_distinct(list_filter(string_split(trim(regexp_replace(upper(text), '[^A-Z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS t FROM documents),
b AS (SELECT item_id, list_distinct(list_filter(string_split(trim(regexp_replace(upper(text), '[^A-Z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS t FROM benchmark),
ub AS (SELECT item_id, len(t) AS n, unnest(t) AS w FROM b), ud AS (SELECT doc_id, len(t) AS n, unnest(t) AS w FROM d),
i AS (SELECT doc_id, item_id, ud.n AS na, ub.n AS nb, count(*) AS c FROM ud JOIN ub USING (w) GROUP BY ALL)
SELECT doc_id, item_id, c AS shared_words, nb AS item_words, round(c / (na + nb - c), 6) AS jaccard FROM i WHERE 2 * c >= nb""")
def token_jaccard(t: Tables) -> DataFrame:
    """Word-set Jaccard of documents and benchmark items, over all words, where a document has half of an item's words or
    more (as any pair with a Jaccard of 0.5 has)."""
    # As in the SQL, letters whose capital is more than one letter part words.
    single = F.translate("text", "ßŉǰẖẗẘẙẚﬀﬁﬂﬃﬄﬅﬆ", " " * 15)
    return match.token_pairs(t.documents.withColumn("text", single), "doc_id", t.benchmark.withColumn("text", single), "item_id", "text").select("doc_id", "item_id", "shared_words", "item_words", "jaccard")


@query("""WITH terms AS (SELECT DISTINCT p_name AS term, substr(p_name, 1, 3) AS target FROM part WHERE p_size <= 10 UNION SELECT DISTINCT split_part(p_name, ' ', 1), 'family' FROM part),
h AS (SELECT n.p_name, term, target, max(length(term)) OVER (PARTITION BY n.p_name) AS longest FROM (SELECT DISTINCT p_name FROM part) n JOIN terms ON n.p_name = term OR starts_with(n.p_name, term || ' ')),
b AS (SELECT p_name, min(term) AS matched_term, CASE WHEN count(DISTINCT target) = 1 THEN min(target) END AS matched_target, count(DISTINCT target) AS n_targets FROM h WHERE length(term) = longest GROUP BY 1)
SELECT p_partkey, part.p_name, matched_term, matched_target, n_targets FROM part LEFT JOIN b ON part.p_name = b.p_name""")
def dictionary_longest_prefix(t: Tables) -> DataFrame:
    exact = t.part.where("p_size <= 10").select(F.col("p_name").alias("term"), F.substring("p_name", 1, 3).alias("target"))
    terms = exact.unionByName(t.part.select(F.split("p_name", " ")[0].alias("term"), F.lit("family").alias("target"))).distinct()
    return match.longest_prefix(t.part.select("p_partkey", "p_name"), "p_name", terms, "term", "target").select("p_partkey", "p_name", "matched_term", "matched_target", "n_targets")


CHANGED = """WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS v FROM orders), a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS v FROM orders)
, j AS (SELECT o_orderkey, b.v AS old_value, a.v AS new_value, CASE WHEN b.v IS NULL AND a.v IS NULL THEN 'open' WHEN b.v IS NULL THEN 'gained' WHEN a.v IS NULL THEN 'lost' WHEN a.v <> b.v THEN 'moved' ELSE 'same' END AS change FROM b JOIN a USING (o_orderkey))"""


def _impact(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    before = t.orders.select("o_orderkey", F.when(key % 5 != 0, F.col("o_orderstatus")).alias("v"))
    after = t.orders.select("o_orderkey", F.when(key % 7 == 0, "X").when(key % 11 != 0, F.col("o_orderstatus")).alias("v"))
    return compare.impact(before, after, "o_orderkey", "v")


@query(CHANGED + "SELECT o_orderkey, old_value, new_value, change FROM j")
def impact_gained_lost_moved(t: Tables) -> DataFrame:
    return _impact(t)


@query(CHANGED + "SELECT coalesce(old_value, '-') AS before_state, coalesce(new_value, '-') AS after_state, count(*) AS n FROM j GROUP BY ALL")
def holdout_transition_matrix(t: Tables) -> DataFrame:
    return compare.transitions(_impact(t), "old_value", "new_value")


@query("""SELECT o_orderkey + 10 AS o_orderkey, CASE WHEN o_orderkey + 10 > (SELECT max(o_orderkey) FROM orders) THEN 'new' ELSE 'changed' END AS kind FROM orders s
WHERE o_orderkey + 10 > (SELECT max(o_orderkey) FROM orders) OR NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = s.o_orderkey + 10 AND o.o_orderstatus = s.o_orderstatus AND o.o_orderpriority = s.o_orderpriority)""")
def incremental_refresh_hash(t: Tables) -> DataFrame:
    old = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return compare.changed_inputs(old, old.withColumn("o_orderkey", F.col("o_orderkey") + 10), "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("""SELECT event_id, event_type, user_id FROM events UNION ALL SELECT event_id + 10000000, event_type, user_id FROM events WHERE event_id % 2 = 1""")
def ledger_idempotent_append(t: Tables) -> DataFrame:
    ledger = t.events.select("event_id", "event_type", "user_id")
    batch = ledger.withColumn("event_id", F.col("event_id") + F.when(F.col("event_id") % 2 == 1, 10_000_000).otherwise(0))
    return govern.append_once(ledger, batch.unionByName(batch), "event_id", ["event_type", "user_id"])[0]


@query("""SELECT event_id FROM events WHERE event_id % 6 = 0""")
def ledger_conflicts(t: Tables) -> DataFrame:
    ledger = t.events.select("event_id", "event_type", "user_id")
    batch = ledger.withColumn("event_type", F.when(F.col("event_id") % 6 == 0, F.concat("event_type", F.lit("!"))).otherwise(F.col("event_type")))
    return govern.append_once(ledger, batch, "event_id", ["event_type", "user_id"])[1]


@query("""SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, count(*) AS links FROM orders GROUP BY 1""")
def chain_head(t: Tables) -> DataFrame:
    return govern.chain_heads(t.orders, "o_custkey", "o_orderkey", ["o_orderstatus"])


@query("""WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN 'X' ELSE p_type END AS p_type FROM part WHERE p_partkey % 40 <> 1 UNION ALL SELECT p_partkey + 1000000, p_type FROM part WHERE p_partkey % 100 = 3)
SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, CASE WHEN o.p_partkey IS NULL THEN 'added' WHEN n.p_partkey IS NULL THEN 'dropped' ELSE 'changed' END AS delta
FROM part o FULL JOIN n ON o.p_partkey = n.p_partkey WHERE o.p_partkey IS NULL OR n.p_partkey IS NULL OR o.p_type <> n.p_type""")
def version_delta(t: Tables) -> DataFrame:
    old = t.part.select("p_partkey", "p_type")
    new = old.where("p_partkey % 40 <> 1").withColumn("p_type", F.when(F.col("p_partkey") % 50 == 0, "X").otherwise(F.col("p_type")))
    new = new.unionByName(old.where("p_partkey % 100 = 3").withColumn("p_partkey", F.col("p_partkey") + 1000000))
    return govern.version_delta(old, new, "p_partkey", ["p_type"])


@query("""WITH l AS (SELECT user_id, max_by(event_type, event_id) AS s, max(event_id) AS attempt FROM events GROUP BY 1) SELECT user_id, attempt, CASE s WHEN 'purchase' THEN 'skip' WHEN 'view' THEN 'refuse' ELSE 'run' END AS claim FROM l""")
def job_claims(t: Tables) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "view", "running").otherwise("failed")
    return govern.claim(t.events.select("user_id", F.col("event_id").alias("attempt"), status.alias("status")), "user_id")


@query("""SELECT CASE WHEN c_custkey % 9 <> 0 THEN c_custkey::VARCHAR END AS id, CASE WHEN c_custkey % 9 <> 0 THEN c_name END AS name,
CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 9 = 0 THEN 'marker' END AS malformed FROM customer""")
def fixed_width_lines(t: Tables) -> DataFrame:
    layout = {"table": (0, 3), "id": (4, 12), "name": (16, 20), "segment": (36, 12)}
    rows = t.customer.select(F.when(F.col("c_custkey") % 9 == 0, "BAD").otherwise("CUS").alias("table"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    lines = rows.select(readers.to_fixed_width(rows, layout, 50).alias("value"))
    return readers.fixed_width(lines, layout, 50, marker=(0, "CUS")).drop("table")


@query("""WITH RECURSIVE t AS (SELECT doc_id AS node, md5(text) AS token FROM documents UNION ALL SELECT doc_id, lang || '/' || source || '/' || (n_chars // 40) FROM documents),
l AS (SELECT DISTINCT a.node AS x, b.y FROM t a JOIN (SELECT token, min(node) AS y FROM t GROUP BY 1) b USING (token)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x AS node, x AS c FROM e UNION SELECT e.x, r.c FROM r JOIN e ON e.y = r.node)
SELECT node AS doc_id, min(c) AS component FROM r GROUP BY 1""")
def leakage_components(t: Tables) -> DataFrame:
    from ..sources.shared import stored

    near = F.concat_ws("/", "lang", "source", F.floor(F.col("n_chars") / 40).cast("string"))
    tokens = t.documents.select("doc_id", F.explode(F.array(F.md5(F.encode("text", "utf-8")), near)).alias("token"))
    return compare.leakage_components(tokens, "doc_id", "token", stored)
