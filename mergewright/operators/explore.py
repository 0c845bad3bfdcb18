"""Counts, facets, shapes, profiles and coverage over a filtered table; each in one pass of the table where it can be."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .predicates import Condition, Field, compile_condition, compile_filter


def facet(df: DataFrame, fields: Mapping[str, Field], conditions: Sequence[Condition], field: str, limit: int) -> DataFrame:
    """The field's most frequent values inside the filter, its own conditions lifted; null isn't a value."""
    col = fields[field].column
    inside = df.where(compile_filter(conditions, fields, lifted=field)).where(F.col(col).isNotNull())
    return inside.groupBy(F.col(col).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def facets(df: DataFrame, fields: Mapping[str, Field], conditions: Sequence[Condition], wanted: Sequence[str], limit: int) -> DataFrame:
    """Several facets at once: one scan with a flag for each condition, unpivoted to (facet, value)."""
    flagged = df.select(*(F.col(fields[w].column).cast("string").alias(f"__v{i}") for i, w in enumerate(wanted)), *(F.coalesce(compile_condition(c, fields), F.lit(False)).alias(f"__c{i}") for i, c in enumerate(conditions)))
    rows = []
    for i, w in enumerate(wanted):
        ok = F.lit(True)
        for j, c in enumerate(conditions):
            ok = ok if c.field == w else ok & F.col(f"__c{j}")
        rows.append(F.struct(F.lit(w).alias("facet"), F.col(f"__v{i}").alias("value"), ok.alias("ok")))
    long = flagged.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("ok AND value IS NOT NULL")
    counted = long.groupBy("facet", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= limit)


def trail(df: DataFrame, fields: Mapping[str, Field], conditions: Sequence[Condition]) -> DataFrame:
    """How many rows remain after each condition in turn, in one pass: (step, n), step 0 being all rows."""
    upto, counts = F.lit(True), [F.count("*").alias("s0")]
    for i, c in enumerate(conditions, 1):
        upto = upto & compile_condition(c, fields)
        counts.append(F.count(F.when(upto, 1)).alias(f"s{i}"))
    one = df.agg(*counts)
    return one.select(F.posexplode(F.array(*one.columns)).alias("step", "n"))


def counters(df: DataFrame, tests: Mapping[str, Column]) -> DataFrame:
    """One row with a count for each test."""
    return df.agg(*(F.count(F.when(t, 1)).alias(n) for n, t in tests.items()))


SHAPES = {"exact": lambda c: c, "leading_token": text.leading_token, "character_shape": text.shape}


def shapes(df: DataFrame, column: str, kind: str, samples: int = 4) -> DataFrame:
    """Rows, distinct values and the most frequent samples of each shape: counted by value first, then by shape."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    shaped = values.withColumn("shape", SHAPES[kind](F.col("value")))
    rank = F.row_number().over(Window.partitionBy("shape").orderBy(F.desc("n"), "value"))
    # Only the first ranks of each task's values reach the window; sums are taken apart.
    first = shaped.withColumn("rank", rank).where(F.col("rank") <= samples)
    picked = first.groupBy("shape").agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("picked"))
    sums = shaped.groupBy("shape").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_values"))
    return sums.join(picked, "shape").select("shape", "n_rows", "n_values", F.concat_ws(" | ", F.transform("picked", lambda x: x["value"])).alias("samples"))


def profile(df: DataFrame, columns: Sequence[str], top: int = 3) -> DataFrame:
    """Of each column: rows with a value, distinct values, and the top values with their counts."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), text.blank_to_null(F.col(c).cast("string")).alias("value")) for c in columns))).alias("x")).select("x.*").where("value IS NOT NULL")
    counted = long.groupBy("field", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
    first = counted.withColumn("rank", rank).where(F.col("rank") <= top)
    picked = first.groupBy("field").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "value", F.col("n").cast("string")).alias("t")))).alias("picked"))
    sums = counted.groupBy("field").agg(F.sum("n").alias("present"), F.count("*").alias("distinct_values"))
    return sums.join(picked, "field").select("field", "present", "distinct_values", F.concat_ws(" | ", F.transform("picked", lambda x: x["t"])).alias("top_values"))


def key_inventory(df: DataFrame, json_column: str) -> DataFrame:
    """Every key of a JSON object column with how many rows hold it, and how many hold a value."""
    pairs = df.select(F.explode(F.from_json(json_column, "map<string,string>")).alias("key", "value"))
    return pairs.groupBy("key").agg(F.count("*").alias("n_rows"), F.count(text.blank_to_null(F.col("value"))).alias("n_filled"), F.countDistinct("value").alias("n_values"))


def uniform(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """For each group the value of a column where the group has just one, else null."""
    return df.groupBy(by).agg(F.count("*").alias("n_rows"), *(F.when(F.countDistinct(c) == 1, F.min(c)).alias(c) for c in columns))


def breakdowns(df: DataFrame, measures: Mapping[str, Column]) -> DataFrame:
    """Several breakdowns of one table in one scan: (breakdown, value, n)."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("breakdown"), c.cast("string").alias("value")) for n, c in measures.items()))).alias("x")).select("x.*")
    return long.where("value IS NOT NULL").groupBy("breakdown", "value").agg(F.count("*").alias("n"))


def reason_maps(df: DataFrame, by: str, reason: str) -> DataFrame:
    """A map reason -> count for each group, as sorted entries."""
    counted = df.groupBy(by, reason).agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(reason).alias("key"), F.col("n"))))
    return counted.groupBy(by).agg(F.map_from_entries(entries).alias("reasons"), F.sum("n").alias("n_rows"))


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Counts of a key on both sides, absent ones as 0."""
    a, b = (x.groupBy(key).agg(F.count("*").alias(n)) for x, n in ((left, "n_left"), (right, "n_right")))
    return a.join(b, key, "full_outer").na.fill(0, ["n_left", "n_right"])


def discriminators(df: DataFrame, columns: Sequence[str], flag: Column) -> DataFrame:
    """Which columns tell flagged rows from others: coverage x separation / (1 + log10 of the distinct values).

    Separation is the mean distance, weighted by rows, of a value's share of flagged rows from the share of all.
    """
    base = df.select(flag.cast("int").alias("__f"), *(F.col(c).cast("string").alias(c) for c in columns))
    long = base.select("__f", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns))).alias("x")).select("__f", "x.*")
    per_value = long.groupBy("field", "value").agg(F.count("*").alias("n"), F.sum("__f").alias("k"))
    total = per_value.groupBy("field").agg(F.sum("n").alias("all_n"), F.sum("k").alias("all_k"))
    x = per_value.join(F.broadcast(total), "field").where("value IS NOT NULL")  # a row for each column
    distance = F.abs(F.col("k") / F.col("n") - F.col("all_k") / F.col("all_n")) * F.col("n")
    out = x.groupBy("field").agg((F.sum("n") / F.max("all_n")).alias("coverage"), (F.sum(distance) / F.sum("n")).alias("separation"), F.count("*").alias("distinct_values"))
    score = F.col("coverage") * F.col("separation") / (1 + F.log10("distinct_values"))
    return out.select("field", F.round("coverage", 4).alias("coverage"), F.round("separation", 4).alias("separation"), "distinct_values", F.round(score, 4).alias("score"), ((F.col("distinct_values") >= 2) & (F.col("separation") >= 0.02)).alias("usable"))
