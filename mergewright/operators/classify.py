"""What several pieces of evidence about one record say together, and which records a change touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evidence_class(rows: DataFrame, keys: list[str], value: Column, mapped: Column) -> DataFrame:
    """Per key one of missing (no value), unmapped (some value without a mapping), mixed (several mapped ones), single, and
    the mapped value where there is one only. min and max do instead of a set, so a hot key costs two values."""
    m = F.when(value.isNotNull(), mapped)
    x = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.count(m).alias("known"), F.min(m).alias("least"), F.max(m).alias("most"))
    told = F.when(F.col("n") == 0, "missing").when(F.col("known") < F.col("n"), "unmapped").when(F.col("least") != F.col("most"), "mixed").otherwise("single")
    return x.select(*keys, told.alias("evidence"), F.when(told == "single", F.col("least")).alias("value"))


def link_summary(owners: DataFrame, links: DataFrame, key: str, linked: str, kind: str, known: str) -> DataFrame:
    """Per owner: linked (one link), multiple:<kind> or multiple (several, of one kind or not), type_known (none, but the
    owner's own field says the kind), missing."""
    n = links.groupBy(key).agg(F.countDistinct(linked).alias("n"), F.min(kind).alias("least"), F.max(kind).alias("most"))
    x = owners.join(n, key, "left")
    several = F.when(F.col("least") == F.col("most"), F.concat(F.lit("multiple:"), F.col("least"))).otherwise("multiple")
    return x.select(key, F.when(F.col("n") == 1, "linked").when(F.col("n") > 1, several).when(F.col(known).isNotNull(), "type_known").otherwise("missing").alias("summary"))


def equivalent_groups(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Groups of rows that no field tells apart (nulls are equal): the fields, the least key and how many, two at least."""
    return rows.groupBy(*fields).agg(F.min(key).alias("representative"), F.count("*").alias("n_equal")).where(F.col("n_equal") > 1)


def one_per_source_key(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per key with its fields, its number of rows, and whether the rows disagree (which a strict load refuses)."""
    content = F.struct(*fields)
    x = rows.groupBy(key).agg(F.min(content).alias("least"), F.max(content).alias("most"), F.count("*").alias("n_rows"))
    return x.select(key, *(F.col(f"least.{f}").alias(f) for f in fields), "n_rows", (~F.col("least").eqNullSafe(F.col("most"))).alias("conflict"))


def touched_by_codes(records: DataFrame, before: DataFrame, after: DataFrame, code: str, meaning: str) -> DataFrame:
    """Records whose code was added, removed or given another meaning between two versions of a code table."""
    old, new = (t.select(code, F.col(meaning).alias(n), F.lit(True).alias(f"has_{n}")) for t, n in ((before, "old"), (after, "new")))
    x = old.join(new, code, "full_outer")
    change = F.when(F.col("has_old").isNull(), "added").when(F.col("has_new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return records.join(x.select(code, change.alias("change")).where("change IS NOT NULL"), code)


def holds_number(text: Column, number: Column) -> Column:
    """Whether a text holds a whole number as it stands: no part of a longer one, nor of a decimal, which is a point or comma
    right between two digits (2.0 isn't 2; "2." and "2, 3" hold 2). Null where either is."""
    joined = F.regexp_replace(text, r"([0-9])[.,](?=[0-9])", "$1_")
    apart = F.concat(F.lit(" "), F.regexp_replace(joined, r"[^0-9_]+", "  "), F.lit(" "))
    return F.contains(apart, F.concat(F.lit(" "), number.cast("string"), F.lit(" ")))


def series_relation(a: Column, b: Column) -> Column:
    """How the digit groups of two names relate, in their order and with repeats: none (one has none), equal, conflict. Null
    where a name is."""
    x, y = (F.regexp_extract_all(c, F.lit("([0-9]+)")) for c in (a, b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), "none").when(x == y, "equal").when(x.isNotNull() & y.isNotNull(), "conflict")
