"""Observations from several sources merged into golden rows, field by field."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OBSERVATION = ["entity", "field", "value", "source", "observed_on"]


def observe(df: DataFrame, entity: Column, source: str, observed_on: Column, fields: Mapping[str, Column]) -> DataFrame:
    """A row per field that has a value: silence is no observation."""
    values = F.array(*(F.struct(F.lit(n).alias("field"), c.cast("string").alias("value")) for n, c in fields.items()))
    long = df.select(entity.alias("entity"), F.lit(source).alias("source"), observed_on.alias("observed_on"), F.explode(values).alias("x"))
    return long.select("entity", "x.field", "x.value", "source", "observed_on").where(F.trim("value") != "")


def ranked(observations: DataFrame, ranks: Mapping[str, int]) -> DataFrame:
    """Observations with their source's rank; a source without one ranks 0."""
    rank = F.lit(0)
    for source, r in ranks.items():
        rank = F.when(F.col("source") == source, r).otherwise(rank)
    return observations.withColumn("rank", rank)


def survivors(observations: DataFrame, ranks: Mapping[str, int]) -> DataFrame:
    """The value of each (entity, field): higher rank, then newer, then the source and value that sort first.

    The winner is the least (-rank, -date, source, value), a combinable aggregate; other values stay as alternatives.
    """
    order = F.struct((-F.col("rank")).alias("r"), (-F.unix_date("observed_on")).alias("d"), F.col("source"), F.col("value"), F.col("observed_on"))
    grouped = ranked(observations, ranks).groupBy("entity", "field").agg(F.min(order).alias("w"), F.array_sort(F.collect_set("value")).alias("all_values"), F.count("*").alias("n_observations"))
    return grouped.select("entity", "field", F.col("w.value").alias("value"), F.col("w.source").alias("source"), F.col("w.observed_on").alias("observed_on"), F.array_remove("all_values", F.col("w.value")).alias("alternatives"), "n_observations")


def retract(observations: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """Observations without those of withdrawn (entity, field, source): the best alternative speaks again."""
    return observations.join(withdrawn.select("entity", "field", "source").distinct(), ["entity", "field", "source"], "left_anti")


def golden(merged: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per entity with a column for each field, and the sources of its values."""
    source = F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "source"))))
    return merged.groupBy("entity").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields), source.alias("field_sources"))


def overlay(base: DataFrame, key: str, fields: Sequence[str], *layers: DataFrame) -> DataFrame:
    """base with values of the layers on top, later layers first; a null in a layer says nothing."""
    out = base
    for n, layer in enumerate(layers):
        side = layer.select(key, *(F.col(f).alias(f"__{n}_{f}") for f in fields))
        out = out.join(side, key, "left").select(*(F.coalesce(f"__{n}_{c}", c).alias(c) if c in fields else F.col(c) for c in out.columns))
    return out


def upsert(old: DataFrame, new: DataFrame, key: str, protected: Sequence[str] = ()) -> DataFrame:
    """old with the rows of new put in by key, except for protected columns, and what happened to each row.

    change: inserted, updated (a column differs), or unchanged.
    """
    side = new.select(key, *(F.col(c).alias(f"__{c}") for c in old.columns if c != key), F.lit(True).alias("__new"))
    had = old.withColumn("__old", F.lit(True))
    joined = had.join(side, key, "full_outer")
    own = [c for c in old.columns if c != key and c not in protected]
    differs = F.lit(False)
    for c in own:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    change = F.when(F.col("__old").isNull(), "inserted").when(F.col("__new") & differs, "updated").otherwise("unchanged")
    take = lambda c: F.when(F.col("__new").isNotNull() & (F.lit(c not in protected) | F.col("__old").isNull()), F.col(f"__{c}")).otherwise(F.col(c))
    return joined.select(*(F.col(c) if c == key else take(c).alias(c) for c in old.columns), change.alias("change"))
