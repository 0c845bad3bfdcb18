"""Queries of cleaners and keys: absent values, measures, accent-tolerant keys, sounds, numbers asked of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evidence
from ..operators.predicates import Condition, Field, compile_filter
from .matching import _sounds
from .registry import Tables, query

_DIRTY = "CASE p_partkey % 6 WHEN 0 THEN '  ' WHEN 1 THEN ' unknown ' WHEN 2 THEN '-' WHEN 3 THEN ' ' || p_name || ' ' WHEN 4 THEN p_name END"
_MEASURE = "CASE p_partkey % 5 WHEN 0 THEN '0' WHEN 1 THEN ' ' || CAST(p_size AS STRING) || ' ' WHEN 2 THEN 'n/a' WHEN 3 THEN '-' || CAST(p_size AS STRING) ELSE '1.5' END"


@query(f"""WITH x AS (SELECT p_partkey, {_DIRTY} AS dirty, {_MEASURE} AS m FROM part)
SELECT p_partkey, CASE WHEN upper(trim(dirty)) NOT IN ('', 'UNKNOWN', '-') THEN trim(dirty) END AS clean, nullif(CASE WHEN regexp_full_match(trim(m), '-?[0-9]+') THEN trim(m)::BIGINT END, 0) AS measure, regexp_replace(upper(dirty), '[^A-Z0-9]', '', 'g') AS compact FROM x""")
def cleaned_values(t: Tables) -> DataFrame:
    x = t.part.selectExpr("p_partkey", f"{_DIRTY} AS dirty", f"{_MEASURE} AS m")
    return x.select("p_partkey", text.cleaned(F.col("dirty")).alias("clean"), text.measure(F.col("m")).alias("measure"), text.compact(F.col("dirty")).alias("compact"))


_WORDS = r"[A-Za-z\x{00C0}-\x{00DE}\x{00E0}-\x{00FF}]+"


@query(rf"""WITH w AS (SELECT unnest(regexp_extract_all(text, '{_WORDS}')) AS word FROM documents)
SELECT upper(strip_accents(word)) AS key, count(*) AS n, count(DISTINCT word) AS spellings, min(word) AS least FROM w GROUP BY 1""")
def accent_tolerant_keys(t: Tables) -> DataFrame:
    """Words of documents by a key without accents and case; the key is made once for each distinct word."""
    words = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit(f"({_WORDS})"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.withColumn("key", text.folded("word")).groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("spellings"), F.min("word").alias("least"))


@query(f"""WITH w AS (SELECT DISTINCT upper(p_name || ' ' || p_type) AS label FROM part), s AS (SELECT label, list_sort(list_distinct({_sounds('label')})) AS codes FROM w)
SELECT label, array_to_string(codes, ' ') AS codes FROM s""")
def sound_codes(t: Tables) -> DataFrame:
    labels = t.part.select(F.upper(F.concat("p_name", F.lit(" "), "p_type")).alias("label")).distinct()
    return labels.select("label", F.array_join(text.phonetic_codes(F.col("label")), " ").alias("codes"))


@query("SELECT p_partkey FROM part")
def filter_numbers_asked_in_words(t: Tables) -> DataFrame:
    """A number column asked for words alone: nothing equals them, and everything differs."""
    size = {"size": Field("p_size", "number")}
    none = t.part.where(compile_filter([Condition("size", "equals", ("large", "n/a"))], size))
    return none.unionByName(t.part.where(compile_filter([Condition("size", "not_equals", ("large", ""))], size))).select("p_partkey")


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS q, CASE p_partkey % 3 WHEN 0 THEN [p_type, 'SUV'] WHEN 1 THEN ['SMALL'] ELSE [] END AS c FROM part)
SELECT p_partkey, CASE WHEN q IS NOT NULL AND len(c) > 0 AND NOT list_contains(c, q) AND q = 'LARGE' AND list_contains(c, 'SMALL') THEN 'body_compatible_not_confirmed' ELSE 'body' END AS name,
CASE WHEN q IS NULL THEN 'none' WHEN len(c) = 0 THEN 'missing' WHEN list_contains(c, q) THEN 'matched' WHEN q = 'LARGE' AND list_contains(c, 'SMALL') THEN 'unverified' ELSE 'conflicting' END AS state FROM p""")
def evidence_bodies(t: Tables) -> DataFrame:
    """One body against a set of them, with a reviewed pair that is compatible."""
    key = F.col("p_partkey")
    bodies = F.when(key % 3 == 0, F.array(F.col("p_type"), F.lit("SUV"))).when(key % 3 == 1, F.array(F.lit("SMALL"))).otherwise(F.array().cast("array<string>"))
    e = evidence.one_value("body", F.when(key % 7 != 0, F.col("p_type")), bodies, [("LARGE", "SMALL")], -0.05)
    return t.part.select("p_partkey", e.alias("e")).select("p_partkey", "e.name", "e.state")
