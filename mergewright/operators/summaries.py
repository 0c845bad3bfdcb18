"""Breakdowns kept as additive counts and sums, changed by what rows say before and after instead of being counted anew.

A summary has a row for each breakdown (kind) and value of it: n rows, and the sum of a measure. Rows that change are taken out
as they were and put in as they are, so an update reads the changed rows and the summary, never the table. Null values are
values; counts that reach 0 leave. Sums are decimal, so that taking out what was put in leaves nothing behind.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sums are kept with so many digits behind the point.
SUM = "decimal(38,4)"


def summarise(rows: DataFrame, breakdowns: Mapping[str, Column], measure: Column, sign: int = 1) -> DataFrame:
    """kind, value, n and total of all breakdowns in one pass; with sign -1 what the rows take out."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.cast("string").alias("value")) for k, c in breakdowns.items())))
    amount = F.coalesce(measure.cast("decimal(28,4)"), F.lit(0).cast("decimal(28,4)"))
    told = rows.select(each.alias("b"), amount.alias("m")).groupBy("b.kind", "b.value").agg(F.count("*").alias("n"), F.sum("m").alias("total"))
    return told.select("kind", "value", (sign * F.col("n")).alias("n"), (sign * F.col("total")).cast(SUM).alias("total"))


def update(summary: DataFrame, before: DataFrame, after: DataFrame, breakdowns: Mapping[str, Column], measure: Column) -> DataFrame:
    """The summary after rows changed: before and after are the changed rows as they were and as they are (new rows are in after
    alone, deleted ones in before alone)."""
    parts = summary.select("kind", "value", "n", F.col("total").cast(SUM).alias("total"))
    parts = parts.unionByName(summarise(before, breakdowns, measure, -1)).unionByName(summarise(after, breakdowns, measure))
    out = parts.groupBy("kind", "value").agg(F.sum("n").alias("n"), F.sum("total").cast(SUM).alias("total"))
    return out.where((F.col("n") != 0) | (F.col("total") != 0))


def disagreements(summary: DataFrame) -> DataFrame:
    """Kinds whose rows or total differ from another kind's: all breakdowns of one table add up to the same. Empty where the
    summary is whole; also negative counts, which no table has."""
    sums = summary.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("n").alias("least"))
    most = sums.agg(F.max("n").alias("most_n"), F.max("total").alias("most_total"))
    return sums.join(F.broadcast(most)).where((F.col("n") != F.col("most_n")) | (F.col("total") != F.col("most_total")) | (F.col("least") < 0)).select("kind", "n", "total")
