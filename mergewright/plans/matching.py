"""Queries of the matcher: likeness joins, scopes of makers, engine codes, and records matched with all their evidence.

Catalogue types are the distinct (name, brand) of part, and records are its rows with some of their type's values bent; both
are stated as SQL expressions that either engine reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import engines, text
from ..operators import evidence, matcher, similar
from .registry import Tables, query

#: Of the least part key k, the name and brand of a type.
TYPE = {
    "c_id": "k",
    "c_maker": "CASE p_brand WHEN 'Brand#1' THEN 'FORD USA' WHEN 'Brand#2' THEN 'JEEP' ELSE replace(upper(p_brand), '#', ' ') END",
    "c_model": "upper(p_name) || CASE WHEN k % 6 = 0 THEN ' 100' WHEN k % 6 = 1 THEN ' 200' ELSE '' END",
    "c_alias": "CASE WHEN k % 5 = 0 THEN split_part(upper(p_name), ' ', 2) || ' ' || split_part(upper(p_name), ' ', 1) END",
    "c_year_from": "CASE WHEN k % 13 <> 0 THEN CAST(1968 + k % 40 AS INT) END",
    "c_year_to": "CASE WHEN k % 11 <> 0 THEN CAST(1969 + k % 40 + k % 5 AS INT) END",
    "c_month_from": "CASE WHEN k % 3 = 0 AND k % 13 <> 0 THEN CAST((1968 + k % 40) * 100 + 1 + k % 12 AS INT) END",
    "c_month_to": "CASE WHEN k % 3 = 0 AND k % 11 <> 0 THEN CAST((1969 + k % 40 + k % 5) * 100 + 1 + k % 12 AS INT) END",
    "fuel_text": "CASE k % 8 WHEN 0 THEN 'PETROL' WHEN 1 THEN 'DIESEL' WHEN 2 THEN 'ELECTRIC' WHEN 3 THEN 'HYBRID PETROL' WHEN 4 THEN 'PETROL,ETHANOL' WHEN 6 THEN 'PETROL' WHEN 7 THEN 'CNG' END",
    "part_text": "CASE WHEN k % 16 = 5 THEN 'PETROL,LPG' END",
    "code_text": "CASE k % 5 WHEN 0 THEN 'BH' || CAST(k % 9 AS STRING) || ' (DV' || CAST(k % 4 AS STRING) || 'C)' WHEN 1 THEN 'K' || CAST(k % 9 AS STRING) || 'K ' || CAST(270 + k % 3 AS STRING) WHEN 2 THEN 'FB' || CAST(20 + k % 4 AS STRING) || 'C;FB' || CAST(20 + k % 4 AS STRING) WHEN 3 THEN 'B' || CAST(k % 9 AS STRING) || '-18 A' END",
    "c_cc": "CASE WHEN k % 10 <> 9 THEN CAST(1000 + (k % 8) * 150 AS INT) END",
    "c_kw": "CASE WHEN k % 17 <> 0 THEN CAST(200 + (k % 12) * 4 AS INT) END",
    "c_drive": "CASE k % 4 WHEN 0 THEN 'FWD' WHEN 1 THEN 'RWD' WHEN 2 THEN 'AWD' END",
    "body_text": "CASE k % 3 WHEN 0 THEN 'SEDAN' WHEN 1 THEN 'ESTATE,SUV' END",
    "c_plug": "CASE WHEN k % 8 = 2 THEN 'battery_electric' WHEN k % 16 = 3 THEN 'plug_in_hybrid' WHEN k % 8 = 3 THEN 'mild_hybrid' END",
    "c_rotary": "k % 7 = 0",
}
#: Of a part's key and the columns of its own type.
RECORD = {
    "q_id": "p_partkey",
    "q_maker": "CASE p_partkey % 25 WHEN 1 THEN replace(c_maker, 'BRAND', 'BRNAD') WHEN 2 THEN replace(c_maker, 'BRAND', 'FROND') WHEN 3 THEN 'NOBODY' WHEN 4 THEN NULL ELSE c_maker END",
    "q_model": "CASE p_partkey % 11 WHEN 1 THEN substr(c_model, 1, 1) || substr(c_model, 3, 1) || substr(c_model, 2, 1) || substr(c_model, 4) WHEN 2 THEN split_part(c_model, ' ', 1) WHEN 3 THEN c_model || ' GT' WHEN 4 THEN replace(c_model, ' 100', ' 300') WHEN 5 THEN replace(c_model, 'I', 'Y') ELSE c_model END",
    "q_year": "CASE WHEN p_partkey % 10 <> 7 THEN CAST(1967 + c_id % 40 + p_partkey % 6 AS INT) END",
    "q_month": "CASE WHEN p_partkey % 10 <> 7 AND p_partkey % 2 = 0 THEN CAST((1967 + c_id % 40 + p_partkey % 6) * 100 + 1 + p_partkey % 12 AS INT) END",
    "q_fuel_text": "CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'PETROL,ELECTRIC' WHEN 2 THEN 'PETROL,ETHANOL' WHEN 3 THEN 'DIESEL' ELSE fuel_text END",
    "q_code": "CASE p_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'ZZ9-' || CAST(p_partkey % 50 AS STRING) WHEN 2 THEN 'DV' || CAST(c_id % 4 AS STRING) || 'C' WHEN 3 THEN 'K' || CAST(c_id % 9 AS STRING) || 'K' WHEN 4 THEN 'BH' || CAST(c_id % 9 AS STRING) || ',DV' || CAST(c_id % 4 AS STRING) || 'C' WHEN 5 THEN 'FB' || CAST(20 + c_id % 4 AS STRING) || 'C, FB' || CAST(20 + c_id % 4 AS STRING) ELSE split_part(code_text, ';', 1) END",
    "q_cc": "CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN c_cc + 2 WHEN 2 THEN 2 * c_cc WHEN 3 THEN c_cc + 100 ELSE c_cc END",
    "q_kw": "CASE p_partkey % 10 WHEN 0 THEN NULL WHEN 1 THEN c_kw + 1 WHEN 2 THEN c_kw - 4 WHEN 3 THEN c_kw - 3 WHEN 4 THEN c_kw - 30 ELSE c_kw END",
    "q_drive": "CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '4WD' ELSE c_drive END",
    "q_body": "CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'MPV' ELSE split_part(body_text, ',', 1) END",
    "q_plug": "CASE WHEN p_partkey % 12 = 5 THEN 'hybrid' END",
}
FUEL_PAIRS, DRIVE_PAIRS, BODY_PAIRS = [("DIESEL", "CNG")], [("4WD", "AWD")], [("MPV", "SUV")]


def _types(t: Tables) -> DataFrame:
    each = t.part.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("k")).selectExpr("p_name", "p_brand", *(f"{e} AS {n}" for n, e in TYPE.items()))
    lists = {"c_fuels": ("fuel_text", ","), "c_parts": ("part_text", ","), "c_codes": ("code_text", ";"), "c_bodies": ("body_text", ",")}
    return each.withColumns({n: F.split(c, mark) for n, (c, mark) in lists.items()})


def _records(t: Tables) -> DataFrame:
    # A small file of many rows is read by few tasks, which would make all records.
    return t.part.repartition("p_partkey").join(_types(t), ["p_name", "p_brand"]).selectExpr(*(f"{e} AS {n}" for n, e in RECORD.items())).withColumn("q_fuels", F.split("q_fuel_text", ",")).drop("q_fuel_text")


def _labels(t: Tables) -> DataFrame:
    return _types(t).select("c_id", F.explode(F.array("c_model", "c_alias")).alias("label")).where("label IS NOT NULL")


def _catalogue(t: Tables) -> DataFrame:
    return _types(t).drop("p_name", "p_brand", "c_alias", "fuel_text", "part_text", "code_text", "body_text")


def osa_sql(a: str, b: str) -> str:
    """The restricted Damerau distance: the last two rows of its table as a pair, folded over the letters of a, and a row over
    those of b."""
    cost = f"CASE WHEN substr({a}, i, 1) = substr({b}, j[1], 1) THEN 0 ELSE 1 END"
    swap = f"CASE WHEN i > 1 AND j[1] > 1 AND substr({a}, i, 1) = substr({b}, j[1] - 1, 1) AND substr({a}, i - 1, 1) = substr({b}, j[1], 1) THEN rows[1][j[1] - 1] + 1 ELSE 1000000 END"
    row = f"list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [j]), lambda row, j: list_append(row, least(row[-1] + 1, rows[2][j[1] + 1] + 1, rows[2][j[1]] + {cost}, {swap})), [i])"
    return f"list_reduce(list_transform(range(1, length({a}) + 1), lambda i: [[i]]), lambda rows, step: list_transform([step[1][1]], lambda i: [rows[2], {row}])[1], [range(0, length({b}) + 1), range(0, length({b}) + 1)])[2][-1]"


def like_sql(a: str, b: str) -> str:
    """The likeness by that distance."""
    return f"(1 - {osa_sql(a, b)} / greatest(length({a}), length({b}))::DOUBLE)"


def _words(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> ''))"


def _sounds(x: str) -> str:
    w = "w"
    for letters, one in text.DIGRAPHS:
        w = f"replace({w}, '{letters}', '{one}')"
    w = f"regexp_replace({w}, 'C([EIY])', 'S\\1', 'g')"
    kept = f"list_transform([{w}], lambda s: CASE WHEN length(s) < 3 THEN '' ELSE replace(translate(substr(s, 1, 1) || regexp_replace(substr(s, 2), '[AEIOUY]', '', 'g'), '{text.SOUNDS[0]}', '{text.SOUNDS[1]}'), 'H', '') END)[1]"
    once = f"list_transform([{kept}], lambda s: array_to_string(list_filter(string_split(s, ''), lambda c, n: n = 1 OR c <> s[n - 1]), ''))[1]"
    return f"list_filter(list_transform(list_filter(regexp_extract_all({x}, '[A-Z0-9]+'), lambda w: regexp_full_match(w, '[A-Z]{{3,}}')), lambda w: {once}), lambda s: s <> '')"


WORDS = """WITH q AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS a FROM benchmark), c AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS b FROM conversations),
near AS (SELECT a, b FROM q JOIN c ON length(b) BETWEEN ceil(0.8 * length(a)) AND floor(length(a) / 0.8) AND levenshtein(a, b) <= 0.4 * greatest(length(a), length(b)) + 0.001)"""


@query(f"{WORDS}, s AS (SELECT a, b, {like_sql('a', 'b')} AS edit FROM near) SELECT a, b, round(edit, 6) AS edit FROM s WHERE edit >= 0.8 - 1e-9")
def similar_labels(t: Tables) -> DataFrame:
    """Words of benchmark items and of conversations that are alike by at least 0.8."""
    words = lambda df, name: df.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias(name)).distinct()
    return similar.similar_labels(words(t.benchmark, "a"), "a", words(t.conversations, "b"), "b", 0.8).select("a", "b", F.round("edit", 6).alias("edit"))


DERIVED = f"""WITH base AS (SELECT p_name, p_brand, min(p_partkey) AS k FROM part GROUP BY 1, 2),
types AS (SELECT p_name, p_brand, {', '.join(f'{e} AS {n}' for n, e in TYPE.items())} FROM base),
records AS (SELECT {', '.join(f'{e} AS {n}' for n, e in RECORD.items())} FROM part JOIN types USING (p_name, p_brand)),
labels AS (SELECT DISTINCT c_id, label FROM (SELECT c_id, unnest([c_model, c_alias]) AS label FROM types) WHERE label IS NOT NULL),
makers AS (SELECT DISTINCT q_maker AS a FROM records WHERE q_maker IS NOT NULL), names AS (SELECT DISTINCT c_maker AS b FROM types),
mm AS (SELECT a, b, a = b AS same, {like_sql("replace(a, ' ', '')", "replace(b, ' ', '')")} AS edit, len(list_intersect({_sounds('a')}, {_sounds('b')})) > 0 AS sound FROM makers, names),
lv AS (SELECT a, b, CASE WHEN same THEN 1 WHEN edit >= 0.8 - 1e-9 THEN 2 WHEN sound AND edit >= 0.4 - 1e-9 THEN 3 END AS level FROM mm),
scopes AS (SELECT a AS q_maker, b AS c_maker, CASE level WHEN 1 THEN 'exact_manufacturer' WHEN 2 THEN 'fuzzy_manufacturer' ELSE 'phonetic_manufacturer' END AS scope FROM lv WHERE level IS NOT NULL QUALIFY level = min(level) OVER (PARTITION BY a))"""


@query(DERIVED + " SELECT * FROM scopes")
def maker_scopes(t: Tables) -> DataFrame:
    return similar.maker_scopes(_records(t), "q_maker", _types(t), "c_maker")


SCORED_LABELS = f"""{DERIVED},
x AS (SELECT *, {_words('a')} AS wa, {_words('b')} AS wb, replace(a, ' ', '') AS la, replace(b, ' ', '') AS lb FROM (SELECT DISTINCT q_model AS a FROM records), (SELECT DISTINCT label AS b FROM labels)),
y AS (SELECT *, len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb)))::DOUBLE AS jac, 1 - levenshtein(la, lb) / 2 / greatest(length(la), length(lb)) AS most FROM x),
z AS (SELECT *, {like_sql('la', 'lb')} AS edit FROM y WHERE CASE WHEN len(wa) = 1 AND len(wb) = 1 THEN most ELSE 0.65 * most + 0.35 * jac END >= 0.55 - 1e-9 OR jac > 0),
sc AS (SELECT a, b, wa, wb, round(CASE WHEN len(list_intersect(wa, wb)) = len(wa) AND len(wa) < len(wb) THEN greatest(v, 0.55::DOUBLE) ELSE v END, 6) AS text_score
  FROM (SELECT *, CASE WHEN len(wa) = 1 AND len(wb) = 1 THEN edit ELSE 0.65::DOUBLE * edit + 0.35::DOUBLE * jac END AS v FROM z)),
scores AS (SELECT * FROM sc WHERE text_score >= 0.55 - 1e-9)"""


@query(SCORED_LABELS + " SELECT a, b, text_score FROM scores")
def label_scores(t: Tables) -> DataFrame:
    """Models of records and labels of types whose text score is at least 0.55."""
    return similar.label_scores(_records(t), "q_model", _labels(t), "label")


def _bare(x: str) -> str:
    return f"regexp_replace(upper({x}), '[^A-Z0-9ÅÄÖÉÜ]', '', 'g')"


def _head(x: str) -> str:
    return f"trim(regexp_replace(upper({x}), '\\([^()]*\\)', ' ', 'g'))"


def _forms(x: str) -> str:
    return f"list_filter(list_distinct(list_concat([{_bare(x)}, {_bare(_head(x))}], list_transform(regexp_extract_all(upper({x}), '\\(([^()]*)\\)', 1), lambda f: {_bare('f')}))), lambda f: f <> '')"


def _family(x: str, revision: bool = True) -> str:
    """As in the reviewed grammar: the stem of a single token with a revision letter, or the first of several tokens."""
    tokens = f"list_filter(regexp_split_to_array({_head(x)}, '[\\s\\-]+'), lambda s: s <> '')"
    stem = f"nullif(regexp_extract({_bare(_head(x))}, '^([A-Z0-9]*[0-9])[A-Z]$', 1), '')"
    first = f"CASE WHEN len({tokens}) >= 2 THEN {_bare(f'{tokens}[1]')} {f'WHEN len({tokens}) = 1 THEN {stem}' if revision else ''} END"
    return f"list_transform([{first}], lambda h: CASE WHEN length(h) >= 3 AND NOT regexp_full_match(h, '[0-9]+') THEN h END)[1]"


def _families(x: str) -> str:
    tokens = f"list_filter(regexp_split_to_array({_head(x)}, '[\\s\\-]+'), lambda s: s <> '')"
    stem = f"CASE WHEN len({tokens}) >= 2 AND NOT contains({x}, ',') THEN nullif(regexp_extract({_bare(_head(x))}, '^([A-Z0-9]*[0-9])[A-Z]$', 1), '') END"
    held = f"list_transform([{stem}], lambda h: CASE WHEN length(h) >= 3 AND NOT regexp_full_match(h, '[0-9]+') THEN h END)[1]"
    return f"list_filter([{_family(x)}, {held}], lambda f: f IS NOT NULL)"


ENGINES = f"""kn AS (SELECT DISTINCT unnest(list_concat({_forms('c')}, [{_family('c', False)}])) AS name FROM (SELECT DISTINCT unnest(string_split(code_text, ';')) AS c FROM types)),
qc AS (SELECT q_code, {_forms('q_code')} AS mine, {_families('q_code')} AS fams, {_family('q_code')} AS fam, {_bare('q_code')} AS bare,
  EXISTS (SELECT 1 FROM kn WHERE list_contains(list_concat({_forms('q_code')}, [{_family('q_code', False)}]), name)) AS known,
  list_transform(list_filter(string_split(q_code, ','), lambda p: {_bare('p')} <> ''), lambda p: {_forms('trim(p)')}) AS listed FROM (SELECT DISTINCT q_code FROM records WHERE q_code IS NOT NULL)),
cc AS (SELECT code_text, list_distinct(flatten(list_transform(own, lambda c: {_forms('c')}))) AS cf, list_distinct(flatten(list_transform(own, lambda c: {_families('c')}))) AS cfam, list_transform(own, lambda c: {_forms('c')}) AS each,
  list_transform(own, lambda c: coalesce({_family('c')}, {_bare('c')})) AS one FROM (SELECT DISTINCT code_text, string_split(code_text, ';') AS own FROM types WHERE code_text IS NOT NULL)),
rel0 AS (SELECT *, len(list_intersect(mine, cf)) > 0 AS hit, len(list_filter(listed, lambda f: len(list_intersect(f, cf)) = 0)) = 0 AS every, len(list_filter(each, lambda f: len(list_intersect(f, flatten(listed))) = 0)) = 0 AS whole FROM qc, cc),
rel AS (SELECT q_code, code_text, CASE WHEN contains(q_code, ',') AND NOT hit AND every AND NOT whole THEN 'engine_code_family' WHEN contains(q_code, ',') AND NOT hit AND every THEN 'engine_code_list'
  WHEN hit THEN 'engine_code' WHEN contains(q_code, ',') THEN CASE WHEN list_contains(cf, coalesce(fam, bare)) OR len(list_intersect(one, mine)) > 0 THEN 'engine_code_family' WHEN known THEN 'conflict' ELSE 'engine_code_unverified' END
  WHEN len(list_intersect(fams, cf)) > 0 OR len(list_intersect(cfam, mine)) > 0 THEN 'engine_code_family' WHEN known THEN 'conflict' ELSE 'engine_code_unverified' END AS relation, contains(q_code, ',') AND NOT hit AND every AND whole AS lists FROM rel0)"""


@query(f"{DERIVED}, {ENGINES} SELECT q_code, code_text, relation FROM rel")
def engine_relations(t: Tables) -> DataFrame:
    """Every code of the records against every set of codes of the types, as pairs of distinct values."""
    asked = engines.with_known(_records(t).select("q_code").where("q_code IS NOT NULL").distinct(), "q_code", _types(t), "c_codes").withColumn("code", engines.described(F.col("q_code")))
    sets = _types(t).select("code_text", "c_codes").where("code_text IS NOT NULL").distinct().withColumn("codes", engines.described_set(F.col("c_codes")))
    # One key for all: distinct codes are a few dozen, as are the sets.
    pairs = asked.withColumn("one", F.lit(1)).join(sets.withColumn("one", F.lit(1)), "one")
    return pairs.select("q_code", "code_text", engines.relation(F.col("code"), F.col("codes"), F.col("code_known")).alias("relation"))


def _told(*cases: tuple[str, str, str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {{'name': '{name}', 'state': '{state}', 'effect': {effect}::DOUBLE}}" for test, name, state, effect in cases) + " END"


def _year_sql(outside: str) -> str:
    return _told(
        ("q_year IS NULL", "year", "none", "0"), ("c_year_from IS NULL AND c_year_to IS NULL", "year", "missing", "0"), (f"gap = 0 AND {outside}", "year_month_outside_unverified", "unverified", "-0.05"),
        ("gap = 0", "year", "matched", "0.05"), ("gap <= 1", "year_adjacent_unverified", "unverified", "-0.05"), ("true", "year", "conflicting", "-0.2"),
    )


def _power_sql(veteran: str) -> str:
    either = lambda kind: f"len(list_filter(list_concat(qf, cfu), lambda f: {kind})) > 0"
    return _told(
        ("q_kw IS NULL", "power_kw", "none", "0"), ("c_kw IS NULL", "power_kw", "missing", "0"), ("q_kw = c_kw", "power_kw", "matched", "0.05"), ("abs(q_kw - c_kw) <= 2", "power_kw", "unverified", "-0.05"),
        ("qf = ['ELECTRIC'] AND cfu = ['ELECTRIC'] AND near_figures = 1 AND abs(c_kw - q_kw) <= 0.02 * c_kw", "power_kw_electric_unverified", "unverified", "-0.05"), (f"q_kw < c_kw AND {either(chr(39).join(('starts_with(f, ', 'HYBRID', ')')))}", "power_kw_hybrid_unverified", "unverified", "-0.05"),
        (f"c_maker IN ('FORD USA', 'JEEP') AND NOT {either(chr(39).join(('starts_with(f, ', 'HYBRID', ') OR starts_with(f, ', 'ELECTRIC', ')')))} AND abs(greatest(q_kw, c_kw) - least(q_kw, c_kw) * 0.7457::DOUBLE / 0.7355::DOUBLE) <= 1.01", "power_kw_horsepower_unit_unverified", "unverified", "-0.05"),
        (veteran, "power_kw_veteran_unverified", "unverified", "-0.05"), ("true", "power_kw", "conflicting", "-0.25"),
    )


_MEET = "(len(list_intersect(qf, {0})) > 0 OR (list_contains({0}, 'HYBRID PETROL') AND list_contains(qf, 'PETROL') AND list_contains(qf, 'ELECTRIC')) OR (list_contains({0}, 'HYBRID DIESEL') AND list_contains(qf, 'DIESEL') AND list_contains(qf, 'ELECTRIC')))"
_PAIR = "(list_contains(qf, 'DIESEL') AND list_contains({0}, 'CNG'))"
_FUELS_SQL = _told(
    ("len(qf) = 0", "fuels", "none", "0"), ("len(cfu) = 0 AND len(cp) = 0", "fuels", "missing", "0"), (f"{_MEET.format('cfu')} AND (len(list_intersect(qf, variants)) = 0 OR len(list_intersect(list_intersect(cfu, qf), variants)) > 0)", "fuels", "matched", "0.05"),
    (_MEET.format("cfu"), "fuels_variant_not_confirmed", "unverified", "-0.05"), (f"{_PAIR.format('cfu')} AND len(list_filter(list_intersect(cfu, variants), lambda f: NOT list_contains(qf, f))) > 0", "fuels_compatible_not_confirmed", "unverified", "-0.05"),
    (f"{_PAIR.format('cfu')} OR {_MEET.format('cp')} OR {_PAIR.format('cp')}", "fuels_compatible_not_confirmed", "unverified", "0"), ("true", "fuels", "conflicting", "-0.15"),
)
_ENGINE_SQL = _told(
    ("relation IS NULL", "engine_code", "none", "0"), ("relation = 'missing'", "engine_code", "missing", "0"), ("relation = 'engine_code'", "engine_code", "matched", "0.12"), ("relation = 'engine_code_list'", "engine_code_list", "matched", "0.12"),
    ("relation = 'engine_code_family'", "engine_code_family", "matched", "0.03"), ("relation = 'engine_code_unverified'", "engine_code_unverified", "unverified", "0"), ("true", "engine_code", "conflicting", "-0.25"),
)
_CC_SQL = _told(
    ("q_cc IS NULL", "displacement_cc", "none", "0"), ("c_cc IS NULL", "displacement_cc", "missing", "0"), ("q_cc = c_cc", "displacement_cc", "matched", "0.05"), ("abs(q_cc - c_cc) <= 3", "displacement_cc_rounding_unverified", "unverified", "-0.05"),
    ("c_rotary AND q_cc = 2 * c_cc", "displacement_cc", "matched", "0.05"), ("true", "displacement_cc", "conflicting", "-0.25"),
)
_DRIVE_SQL = _told(("q_drive IS NULL", "drive_type", "none", "0"), ("c_drive IS NULL", "drive_type", "missing", "0"), ("q_drive = c_drive", "drive_type", "matched", "0.05"), ("q_drive = '4WD' AND c_drive = 'AWD'", "drive_type_compatible_not_confirmed", "unverified", "0"), ("true", "drive_type", "conflicting", "-0.15"))
_BODY_SQL = _told(
    ("q_body IS NULL", "bodywork", "none", "0"), ("body_text IS NULL", "bodywork", "missing", "0"), ("list_contains(string_split(body_text, ','), q_body)", "bodywork", "matched", "0.05"),
    ("q_body = 'MPV' AND list_contains(string_split(body_text, ','), 'SUV')", "bodywork_compatible_not_confirmed", "unverified", "-0.05"), ("true", "bodywork", "conflicting", "-0.15"),
)
_SERIES_SQL = _told(("len(ga) > 0 AND len(gb) > 0 AND ga <> gb", "model_series", "conflicting", "-0.35"), ("true", "model_series", "none", "0"))
_SUM = "round(text_score + list_sum(list_transform(list_concat(fixed, [{0}, {1}]), lambda e: e.effect)) + sound, 6)"
_LIST = "list_transform(list_filter({0}, lambda e: e.state IN ({1})), lambda e: e.name)"

MATCHED = f"""{SCORED_LABELS}, {ENGINES},
best AS (SELECT a AS q_model, c_id, max({{'s': text_score, 'w': -len(wb), 'n': -length(b), 'b': b}}) AS m, FROM scores JOIN labels ON b = label GROUP BY 1, 2),
nf AS (SELECT DISTINCT c_maker, c_model, c_kw FROM types WHERE c_kw IS NOT NULL),
p0 AS (SELECT r.*, t.*, s.scope, m.s AS text_score, m.b AS matched_label, CASE WHEN r.q_code IS NULL OR {_bare('r.q_code')} = '' THEN NULL WHEN t.code_text IS NULL THEN 'missing'
   WHEN rel.lists AND t.c_plug IN ('battery_electric') AND NOT coalesce(r.q_year IS NULL OR r.q_year < t.c_year_from OR r.q_year > t.c_year_to, false) THEN 'engine_code' ELSE rel.relation END AS relation,
   (SELECT count(*) FROM nf WHERE nf.c_maker = t.c_maker AND nf.c_model = t.c_model AND abs(nf.c_kw - r.q_kw) <= 0.02 * nf.c_kw) AS near_figures
  FROM records r JOIN scopes s ON s.q_maker = r.q_maker JOIN best b ON b.q_model = r.q_model JOIN types t ON t.c_id = b.c_id AND t.c_maker = s.c_maker LEFT JOIN rel ON rel.q_code = r.q_code AND rel.code_text = t.code_text),
p1 AS (SELECT *, coalesce(string_split(q_fuel_text, ','), []) AS qf, coalesce(string_split(fuel_text, ','), []) AS cfu, coalesce(string_split(part_text, ','), []) AS cp, ['ETHANOL', 'LPG', 'CNG', 'HYBRID PETROL', 'HYBRID DIESEL'] AS variants,
   regexp_extract_all(q_model, '[0-9]+') AS ga, regexp_extract_all(matched_label, '[0-9]+') AS gb, greatest(0, c_year_from - q_year, q_year - c_year_to) AS gap, coalesce(q_month < c_month_from, false) OR coalesce(q_month > c_month_to, false) AS outside,
   split_part(c_model, ' ', 1) = split_part(q_model, ' ', 1) AS same_line, CASE WHEN text_score >= 0.35 AND text_score < 1 AND len(list_intersect({_sounds('q_model')}, {_sounds('matched_label')})) > 0 THEN 0.08 ELSE 0.0 END::DOUBLE AS sound,
   {_words('q_model')} AS wq, {_words('matched_label')} AS wl FROM p0),
p2 AS (SELECT *, len(list_intersect(wq, wl)) = len(wq) AND len(wq) < len(wl) AS partial, [{_SERIES_SQL}, {_FUELS_SQL}, {_ENGINE_SQL}, {_CC_SQL}, {_DRIVE_SQL}, {_BODY_SQL}] AS fixed, {_year_sql('outside AND NOT same_line')} AS y0, {_power_sql('q_year < 1975')} AS w0, {_power_sql('false')} AS w1 FROM p1),
p3 AS (SELECT *, bool_or(c_kw IS NOT NULL AND w0.state <> 'conflicting' AND w0.name <> 'power_kw_veteran_unverified') OVER (PARTITION BY q_id) AS counts FROM p2 WHERE least({_SUM.format('y0', 'w0')}, 1) >= 0.55),
p4 AS (SELECT *, CASE WHEN counts THEN w1 ELSE w0 END AS w FROM p3),
p5 AS (SELECT *, len({_LIST.format('list_concat(fixed, [y0, w])', "'conflicting'")}) > 0 AS clash FROM p4 WHERE least({_SUM.format('y0', 'w')}, 1) >= 0.55),
p6 AS (SELECT *, coalesce(list(DISTINCT split_part(c_model, ' ', 1)) FILTER (q_month IS NOT NULL AND NOT clash AND (c_month_from IS NOT NULL OR c_month_to IS NOT NULL) AND NOT outside) OVER (PARTITION BY q_id), []) AS lines FROM p5),
p7 AS (SELECT *, outside AND CASE WHEN len(lines) > 0 THEN clash OR NOT same_line OR list_contains(lines, split_part(c_model, ' ', 1)) ELSE NOT same_line END AS demoted FROM p6),
p8 AS (SELECT *, {_year_sql('demoted')} AS y FROM p7),
p9 AS (SELECT *, {_SUM.format('y', 'w')} AS separation, list_concat(fixed, [y, w]) AS ev FROM p8),
cand AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, separation)) AS conf, list_concat(['model'], CASE WHEN partial THEN ['model_partial'] ELSE [] END, CASE WHEN sound > 0 THEN ['model_phonetic'] ELSE [] END, {_LIST.format('ev', "'matched'")}) AS matched,
   {_LIST.format('ev', "'missing', 'unverified'")} AS missing, {_LIST.format('ev', "'conflicting'")} AS conflicting FROM p9 WHERE least(separation, 1) >= 0.55),
rk AS (SELECT *, row_number() OVER w AS rank, count(*) OVER (PARTITION BY q_id) AS n_candidates, CASE WHEN lead(separation) OVER w IS NULL THEN 1.0 ELSE greatest(0.0::DOUBLE, round(separation - lead(separation) OVER w, 6)) END AS margin FROM cand WINDOW w AS (PARTITION BY q_id ORDER BY separation DESC, c_id))"""


def _candidates(t: Tables) -> DataFrame:
    return matcher.scored(_records(t), _catalogue(t), _labels(t), fuel_pairs=FUEL_PAIRS, drive_pairs=DRIVE_PAIRS, body_pairs=BODY_PAIRS)


@query(MATCHED + """ SELECT q_id, c_id, scope, matched_label, text_score, separation, rank::INT AS rank, margin::DOUBLE AS margin, n_candidates, array_to_string(matched, ',') AS matched, array_to_string(missing, ',') AS missing, array_to_string(conflicting, ',') AS conflicting FROM rk WHERE rank <= 5""")
def matcher_topk(t: Tables) -> DataFrame:
    """The five best types of each record with all evidence."""
    x = matcher.ranked(_candidates(t)).where("rank <= 5")
    return x.select("q_id", "c_id", "scope", "matched_label", "text_score", "separation", "rank", "margin", "n_candidates", *(F.array_join(c, ",").alias(c) for c in ("matched", "missing", "conflicting")))


ROUTED = MATCHED + """, top AS (SELECT q_id, separation AS ts, matched AS tm, missing AS tmi, c_plug AS tp, qf AS tf, q_plug AS tq, margin AS tmar, n_candidates AS tn FROM rk WHERE rank = 1),
gd AS (SELECT q_id, bool_or(coalesce(tq <> 'hybrid', true) AND list_contains(tm, 'power_kw') AND NOT (tn > 1 AND tmar < 0.08) AND list_contains(tf, 'ELECTRIC') AND len(list_intersect(tf, ['PETROL', 'DIESEL', 'HYBRID PETROL', 'HYBRID DIESEL'])) > 0 AND tp IS NOT NULL AND tp NOT IN ('plug_in_hybrid', 'range_extender')
    AND rank > 1 AND len(conflicting) = 0 AND list_contains(missing, 'power_kw_hybrid_unverified') AND coalesce(c_plug IN ('plug_in_hybrid', 'range_extender'), false)
    AND round(ts - 0.05::DOUBLE - (separation + 0.05::DOUBLE) - CASE WHEN list_contains(tm, 'displacement_cc') AND list_contains(missing, 'displacement_cc_rounding_unverified') THEN 0.10::DOUBLE ELSE 0 END, 6) < 0.08) AS plug_in,
  bool_or(rank > 1 AND list_contains(matched, 'displacement_cc') AND conflicting = ['engine_code'] AND list_contains(tmi, 'displacement_cc_rounding_unverified')) AS rounding FROM rk JOIN top USING (q_id) GROUP BY 1),
d0 AS (SELECT *, n_candidates > 1 AND margin < 0.08 AS close, list_filter(matched, lambda m: m NOT IN ('model', 'model_phonetic')) AS observed,
  list_sort(list_intersect(conflicting, ['displacement_cc', 'engine_code', 'fuels', 'manufacturer', 'model_series', 'power_kw', 'year'])) AS hard FROM rk JOIN gd USING (q_id) WHERE rank = 1),
d1 AS (SELECT *, CASE WHEN len(conflicting) > 0 THEN 'context_conflict_requires_review' WHEN scope <> 'exact_manufacturer' THEN 'manufacturer_scope_requires_review' WHEN sound > 0 THEN 'phonetic_candidate_requires_review' WHEN partial THEN 'partial_model_requires_review'
   WHEN plug_in THEN 'candidate_margin_not_met' WHEN conf < 0.9 THEN 'automatic_threshold_not_met' WHEN close OR rounding OR (len(list_intersect(missing, ['power_kw_horsepower_unit_unverified', 'displacement_cc_rounding_unverified'])) > 0
     AND len(list_intersect(matched, ['power_kw', 'displacement_cc', 'engine_code', 'engine_code_alias', 'engine_code_list'])) = 0) THEN 'candidate_margin_not_met' ELSE 'automatic_candidate_threshold_met' END AS reason,
   round(round(0.5::DOUBLE * text_score, 6) + round(0.2::DOUBLE * CASE scope WHEN 'exact_manufacturer' THEN 1.0 WHEN 'fuzzy_manufacturer' THEN 0.65 ELSE 0.5 END::DOUBLE, 6)
     + round(0.2::DOUBLE * CASE WHEN len(observed) + len(missing) + len(conflicting) > 0 THEN (len(observed) + 0.5 * len(missing)) / (len(observed) + len(missing) + len(conflicting))::DOUBLE ELSE 0.5 END, 6) + round(0.1::DOUBLE * least(1.0::DOUBLE, margin / 0.08::DOUBLE), 6), 6) AS routed FROM d0),
d2 AS (SELECT *, CASE WHEN len(hard) > 0 THEN 'hard_conflict:' || array_to_string(hard, ',') WHEN reason = 'context_conflict_requires_review' THEN 'non_hard_context_conflict' WHEN scope <> 'exact_manufacturer' THEN 'manufacturer_scope_not_exact'
   WHEN partial THEN 'partial_model_requires_review' WHEN sound > 0 THEN 'phonetic_evidence_requires_review' WHEN reason = 'candidate_margin_not_met' OR close THEN 'candidate_margin_below_gate' END AS gate FROM d1),
d3 AS (SELECT *, coalesce(gate, CASE WHEN routed >= 0.9 AND list_contains(missing, 'engine_code_unverified') THEN 'engine_code_unverified' WHEN routed >= 0.9 THEN 'resolved_threshold_met' WHEN routed >= 0.7 THEN 'provisional_threshold_met' ELSE 'provisional_threshold_not_met' END) AS why FROM d2),
dec AS (SELECT r.q_id, d.c_id AS top_reference, d.separation, d.margin::DOUBLE AS margin, coalesce(d.n_candidates, 0)::BIGINT AS n_candidates, coalesce(d.reason, 'no_candidate_above_threshold') AS reason, coalesce(d.routed, 0.0)::DOUBLE AS confidence,
  CASE WHEN d.why IS NULL OR d.gate IS NOT NULL OR d.why = 'provisional_threshold_not_met' THEN 'review_required' WHEN d.why = 'resolved_threshold_met' THEN 'resolved' ELSE 'provisional' END AS route, coalesce(d.why, 'no_candidate_above_threshold') AS route_reason
  FROM records r LEFT JOIN d3 d ON d.q_id = r.q_id)"""


@query(ROUTED + " SELECT * FROM dec")
def matcher_routes(t: Tables) -> DataFrame:
    """One route for each record, by all guards and gates."""
    return matcher.decided(_candidates(t), _records(t))


@query(f"""{DERIVED}, nf AS (SELECT DISTINCT c_maker, c_kw FROM types WHERE c_kw IS NOT NULL),
r AS (SELECT p_partkey AS q_id, t.c_id, t.c_kw, t.c_maker, CASE WHEN p_partkey % 5 <> 0 THEN (t.c_kw + p_partkey % 9 - 4)::INT END AS q_kw FROM part JOIN types t USING (p_name, p_brand))
SELECT q_id, c_id, c_kw, q_kw, coalesce((SELECT list(n.c_kw) FROM nf n WHERE n.c_maker = r.c_maker AND abs(n.c_kw - r.q_kw) <= 0.02 * n.c_kw) = [c_kw], false) AS only_near FROM r""")
def only_power_near(t: Tables) -> DataFrame:
    """Whether a type's power is the only figure of its maker within 2 % of a record's."""
    types = evidence.neighbours(_types(t), ["c_maker"], "c_kw")
    x = t.part.join(types, ["p_name", "p_brand"]).withColumn("q_kw", F.when(F.col("p_partkey") % 5 != 0, (F.col("c_kw") + F.col("p_partkey") % 9 - 4).cast("int")))
    return x.select(F.col("p_partkey").alias("q_id"), "c_id", "c_kw", "q_kw", evidence.only_near(F.col("q_kw"), F.col("c_kw"), F.col("before_c_kw"), F.col("after_c_kw")).alias("only_near"))
