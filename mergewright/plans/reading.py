"""Queries that read vocabularies in texts, and that resolve records through stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cascade, readings, vocabulary
from .registry import Tables, query

#: Every run of two or three words of the benchmark items is a term; its target is the first digit of its hash.
TERMS_SQL = r"""WITH norm AS (SELECT 'b' AS kind, item_id AS id, text FROM benchmark UNION ALL SELECT 'd', doc_id, text FROM documents),
marks AS (SELECT kind, id, list_filter(string_split(upper(regexp_replace(regexp_replace(regexp_replace(replace(text, '~', ' '), '([0-9])[.,]([0-9])', '\1~ \2', 'g'), '([0-9])[.,]([0-9])', '\1~ \2', 'g'), '[^A-Za-z0-9~]+', ' ', 'g')), ' '), lambda w: w <> '') AS m FROM norm),
places AS (SELECT kind, id, m, unnest(range(len(m)))::INT AS place FROM marks),
windows AS (SELECT kind, id, place, n::INT AS n_words, array_to_string(list_transform(m[place + 1:place + n], lambda w: rtrim(w, '~')), ' ') AS term, (place > 0 AND ends_with(m[place], '~')) OR ends_with(m[place + n], '~') AS cut FROM places, unnest([2, 3]) u(n) WHERE place + n <= len(m)),
terms AS (SELECT DISTINCT term, substr(md5(term), 1, 1) AS target FROM windows WHERE kind = 'b' UNION SELECT DISTINCT term, 'X' FROM windows WHERE kind = 'b' AND starts_with(md5(term), 'a')),
hits AS (SELECT id AS doc_id, place, n_words, term, target FROM windows JOIN terms USING (term) WHERE kind = 'd' AND NOT cut)"""


def _terms(t: Tables) -> DataFrame:
    m = F.transform(vocabulary.marked_words(F.col("text")), lambda w: F.rtrim(w, F.lit("~")))
    runs = t.benchmark.select(m.alias("m")).select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("m"), F.lit(1))), lambda i: F.array(F.slice("m", i, 2), F.slice("m", i, 3)))).alias("two")).select(F.explode("two").alias("w"))
    terms = runs.where(F.size("w") > 1).select(F.array_join("w", " ").alias("term")).distinct()
    named = terms.withColumn("target", F.substring(F.md5("term"), 1, 1))
    return named.unionByName(named.where("target = 'a'").withColumn("target", F.lit("X")))


@query(TERMS_SQL + " SELECT doc_id, place, n_words, term, target FROM hits")
def vocabulary_hits(t: Tables) -> DataFrame:
    """Every run of two or three words of a benchmark item in every document."""
    return vocabulary.read_terms(t.documents, "doc_id", "text", _terms(t), "term", "target")


@query(TERMS_SQL + """, o AS (SELECT *, (place < 50)::INT AS tier, length(replace(term, ' ', '')) AS letters FROM hits),
b AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n_hits FROM o) QUALIFY rank() OVER (PARTITION BY doc_id ORDER BY tier DESC, letters DESC) = 1)
SELECT doc_id, min({'t': term, 'p': place}).t AS term, min({'t': term, 'p': place}).p AS place, CASE WHEN count(DISTINCT target) = 1 THEN min(target) END AS target, count(DISTINCT target) AS n_targets, min(tier) AS tier, min(n_hits) AS n_hits FROM b GROUP BY 1""")
def vocabulary_named(t: Tables) -> DataFrame:
    """What each document is taken to name: within its first fifty words, else anywhere; then the longest."""
    return vocabulary.named(vocabulary_hits(t), "doc_id", F.col("place") < 50)


#: Stages: name, the keys that rules of two thirds of the parts share with a part, and a guard of the part and the rule's least
#: price and largest size. Names and keys are SQL that either engine reads.
STAGES = [
    ("whole", ["p_name", "p_type", "p_size", "floor(p_retailprice)"], None),
    ("name_type_size", ["p_name", "p_type", "p_size"], "p_retailprice >= r_low"),
    ("name_type_decade", ["p_name", "p_type", "floor(p_size / 10)"], "p_retailprice >= r_low"),
    ("name_size", ["p_name", "p_size"], "p_size < r_high + 1"),
    ("first_type_size", ["split_part(p_name, ' ', 1)", "p_type", "p_size"], "p_retailprice >= r_low"),
    ("last_type_size", ["split_part(p_name, ' ', 2)", "p_type", "p_size"], "p_retailprice >= r_low"),
    ("prefix_price", ["substr(p_name, 1, 2)", "floor(p_retailprice / 2)"], None),
    ("suffix_price", ["split_part(p_name, ' ', 2)", "floor(p_retailprice / 2)"], None),
    ("price", ["floor(p_retailprice)"], "p_size <= r_high"),
    ("type_size_half", ["p_type", "p_size", "p_partkey % 97"], None),
    ("letters", ["length(p_name)", "p_size", "p_partkey % 41"], "p_retailprice >= r_low"),
]


def _cascade_sql() -> str:
    parts = ["WITH o0 AS (SELECT *, [CASE WHEN p_size <= 2 THEN 'small:terminal' ELSE 'small:none' END] AS trace FROM part), e0 AS (SELECT p_partkey, 'small' AS branch, 'terminal' AS outcome, NULL::VARCHAR AS target, trace FROM o0 WHERE p_size <= 2), l0 AS (SELECT * FROM o0 WHERE p_size > 2)"]
    for i, (name, keys, guard) in enumerate(STAGES, 1):
        ks = ", ".join(f"{k} AS k{j}" for j, k in enumerate(keys))
        on = " AND ".join(f"{k} = r{i}.k{j}" for j, k in enumerate(keys))
        parts.append(f"""r{i} AS (SELECT {ks}, p_brand AS r_target, min(p_retailprice) AS r_low, max(p_size) AS r_high FROM part WHERE p_partkey % 3 > 0 GROUP BY ALL),
j{i} AS (SELECT p_partkey, count(DISTINCT r_target) FILTER ({guard or 'true'}) AS n, min(r_target) FILTER ({guard or 'true'}) AS t FROM l{i - 1} JOIN r{i} ON {on} GROUP BY 1),
w{i} AS (SELECT l.*, CASE WHEN n IS NULL THEN 'none' WHEN n = 0 THEN 'refused' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS what, t FROM l{i - 1} l LEFT JOIN j{i} ON j{i}.p_partkey = l.p_partkey),
e{i} AS (SELECT p_partkey, '{name}' AS branch, what AS outcome, CASE WHEN what = 'resolved' THEN t END AS target, list_append(trace, '{name}:' || what) AS trace FROM w{i} WHERE what IN ('resolved', 'ambiguous')),
l{i} AS (SELECT * EXCLUDE (what, t, trace), list_append(trace, '{name}:' || what) AS trace FROM w{i} WHERE what NOT IN ('resolved', 'ambiguous'))""")
    ends = " UNION ALL ".join(f"SELECT * FROM e{i}" for i in range(len(STAGES) + 1))
    return ", ".join(parts) + f", done AS ({ends} UNION ALL SELECT p_partkey, NULL, 'unresolved', NULL, trace FROM l{len(STAGES)})"


def _cascaded(t: Tables) -> DataFrame:
    stages = [cascade.Stage("small", test=F.col("p_size") <= 2)]
    for name, keys, guard in STAGES:
        rules = t.part.where("p_partkey % 3 > 0").groupBy(*(F.expr(k).alias(f"k{j}") for j, k in enumerate(keys)), F.col("p_brand").alias("target")).agg(F.min("p_retailprice").alias("low"), F.max("p_size").alias("high"))
        stages.append(cascade.Stage(name, rules, {f"k{j}": F.expr(k) for j, k in enumerate(keys)}, F.expr(guard) if guard else None))
    return cascade.resolve(t.part, "p_partkey", stages)


@query(_cascade_sql() + " SELECT p_partkey, branch, outcome, target, array_to_string(trace, ' ') AS trace FROM done")
def cascade_resolved(t: Tables) -> DataFrame:
    """The brand of each part by twelve stages of rules learnt from two thirds of the parts."""
    return _cascaded(t).withColumn("trace", F.array_join("trace", " "))


@query(_cascade_sql() + " SELECT coalesce(branch, '-') AS branch, outcome, count(*) AS n, max(len(trace)) AS n_stages FROM done GROUP BY ALL")
def cascade_branches(t: Tables) -> DataFrame:
    """How many parts each branch decides."""
    return _cascaded(t).groupBy(F.coalesce("branch", F.lit("-")).alias("branch"), "outcome").agg(F.count("*").alias("n"), F.max(F.size("trace")).cast("long").alias("n_stages"))


READINGS_SQL = """WITH rd AS (SELECT p_partkey, unnest([0, 1, 2])::INT AS position, p_name, p_type FROM part),
r AS (SELECT p_partkey, position, CASE position WHEN 2 THEN split_part(p_name, ' ', 1) || ' widget' ELSE p_name END AS name, CASE WHEN position <> 1 THEN p_type END AS type FROM rd WHERE NOT (position = 2 AND p_partkey % 4 = 0)),
c AS (SELECT p_name AS name, p_type AS type, p_brand, p_size, p_partkey AS id FROM part WHERE p_partkey % 10 < 3),
a AS (SELECT r.name, r.type, count(DISTINCT p_brand) AS n, min(id) AS reference, max(p_size) - min(p_size) > 30 AS conflicts FROM (SELECT DISTINCT name, type FROM r) r JOIN c ON r.name = c.name AND (r.type IS NULL OR r.type = c.type) GROUP BY 1, 2),
x AS (SELECT r.p_partkey, position, reference, CASE WHEN n = 1 THEN 'resolved' WHEN n <= 4 THEN 'provisional' ELSE 'review_required' END AS route, coalesce(round(1 / n, 6), 0.0)::DOUBLE AS confidence, coalesce(conflicts, false) AS conflicts FROM r LEFT JOIN a ON r.name = a.name AND r.type IS NOT DISTINCT FROM a.type),
k AS (SELECT *, CASE route WHEN 'resolved' THEN 0 WHEN 'provisional' THEN 1 ELSE 2 END AS rk, count(*) OVER (PARTITION BY p_partkey) AS n_readings FROM x),
f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY rk, confidence DESC, position) = 1),
g AS (SELECT k.* FROM k JOIN f ON k.p_partkey = f.p_partkey WHERE f.conflicts AND NOT k.conflicts AND k.rk <= f.rk QUALIFY row_number() OVER (PARTITION BY k.p_partkey ORDER BY k.rk, k.confidence DESC, k.position) = 1),
w AS (SELECT f.p_partkey, coalesce(g.position, f.position) AS position, CASE WHEN g.position IS NULL THEN f.reference ELSE g.reference END AS reference, coalesce(g.route, f.route) AS route, coalesce(g.confidence, f.confidence) AS confidence, g.position IS NOT NULL AS replaced, f.n_readings FROM f LEFT JOIN g ON g.p_partkey = f.p_partkey),
h AS (SELECT w.p_partkey, count(*) FILTER (k.route <> 'review_required' AND w.route <> 'review_required' AND k.reference <> w.reference AND NOT k.conflicts) > 0 AS contested, count(*) FILTER (k.conflicts) = count(k.position) AND count(k.position) > 0 AS alone, count(*) FILTER (k.reference = w.reference) = 0 AS unsupported
  FROM w LEFT JOIN k ON k.p_partkey = w.p_partkey AND k.position <> w.position GROUP BY 1)
SELECT p_partkey, position, reference, CASE WHEN contested OR alone OR unsupported THEN 'review_required' ELSE route END AS route, confidence, replaced, array_to_string(list_filter([CASE WHEN contested THEN 'contested' END, CASE WHEN alone THEN 'alone' END, CASE WHEN unsupported THEN 'unsupported' END], lambda v: v IS NOT NULL), ',') AS held, n_readings
FROM w JOIN h USING (p_partkey)"""


@query(READINGS_SQL)
def readings_decided(t: Tables) -> DataFrame:
    """Parts read by name and type, by name alone, and by another name: each distinct reading is looked up once, and guards look
    at the readings beside the winner."""
    position = F.explode(F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2))))
    rows = t.part.select("p_partkey", position.alias("position"), "p_name", "p_type")
    name = F.when(F.col("position") == 2, F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" widget"))).otherwise(F.col("p_name"))
    rows = rows.select("p_partkey", "position", name.alias("name"), F.when(F.col("position") != 1, F.col("p_type")).alias("type"))
    known = t.part.where("p_partkey % 10 < 3").select(F.col("p_name").alias("name"), F.col("p_type").alias("__type"), "p_brand", "p_size", "p_partkey")

    def evaluate(distinct: DataFrame) -> DataFrame:
        met = distinct.join(known, "name").where(F.col("type").isNull() | (F.col("type") == F.col("__type")))
        n = F.countDistinct("p_brand")
        route = F.when(n == 1, "resolved").when(n <= 4, "provisional").otherwise("review_required")
        return met.groupBy("reading_id").agg(F.min("p_partkey").alias("reference"), route.alias("route"), F.round(1 / n, 6).alias("confidence"), (F.max("p_size") - F.min("p_size") > 30).alias("conflicts"))

    stands = lambda s: F.col(f"{s}.route") != "review_required"
    guards = {
        "contested": ("any", stands("s") & stands("w") & (F.col("s.reference") != F.col("w.reference")) & ~F.col("s.conflicts")), "alone": ("all", F.col("s.conflicts")), "unsupported": ("none", F.col("s.reference") == F.col("w.reference")),
    }
    return readings.decide(rows, "p_partkey", ["name", "type"], evaluate, guards).withColumn("held", F.array_join("held", ","))
