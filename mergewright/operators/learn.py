"""Enrichment rules learned from agreeing rows, applied, previewed and withdrawn set-wise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .latest import signature


def majority_rules(df: DataFrame, keys: Sequence[str], target: str, family: str, support: int = 5, agreement: float = 0.95) -> DataFrame:
    """A rule for each key combination whose most frequent target value is frequent and agreed enough.

    Counts by (keys, value) are combined before the shuffle, so a hot key costs its distinct values, not its rows. Ties
    go to the lesser value. support counts the rows that agree.
    """
    known = df.where(F.col(target).isNotNull() & _all_known(keys))
    counted = known.groupBy(*keys, F.col(target).cast("string").alias("value")).agg(F.count("*").alias("n"))
    top = counted.groupBy(*keys).agg(F.sum("n").alias("total"), F.max("n").alias("support"))
    best = counted.join(top, list(keys)).where("n = support").groupBy(*keys, "total", "support").agg(F.min("value").alias("value"))
    rules = best.withColumn("agreement", F.col("support") / F.col("total")).where((F.col("support") >= support) & (F.col("agreement") >= agreement))
    named = rules.withColumns({"family": F.lit(family), "target": F.lit(target)})
    return named.withColumn("rule_id", F.concat(F.lit(f"{family}-"), F.substring(signature("family", *keys, "value"), 1, 12)))


def _all_known(keys: Sequence[str]) -> Column:
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return known


def apply_rules(df: DataFrame, rules: DataFrame, keys: Sequence[str], target: str, replaceable: Sequence[str] = ()) -> DataFrame:
    """df with the target filled where it is null or replaceable, and filled_by: the rule that filled it.

    Rules are few beside rows; Spark broadcasts them where their size at run time allows it, and joins by shuffles where not.
    """
    side = rules.select(*keys, F.col("value").alias("__value"), F.col("rule_id").alias("__rule"))
    open_ = F.col(target).isNull() | (F.col(target).cast("string").isin(*replaceable) if replaceable else F.lit(False))
    fills = open_ & F.col("__value").isNotNull() & ~F.col("__value").eqNullSafe(F.col(target).cast("string"))
    joined = df.join(side, list(keys), "left")
    kind = df.schema[target].dataType
    return joined.select(*(F.when(fills, F.col("__value").cast(kind)).otherwise(F.col(c)).alias(c) if c == target else F.col(c) for c in df.columns), F.when(fills, F.col("__rule")).alias("filled_by"))


def retract(filled: DataFrame, rule_ids: DataFrame, target: str) -> DataFrame:
    """Fills of withdrawn rules are empty again."""
    gone = rule_ids.select(F.col("rule_id").alias("__gone")).distinct()
    joined = filled.join(gone, F.col("filled_by") == F.col("__gone"), "left")
    lost = F.col("__gone").isNotNull()
    return joined.select(*(F.when(lost, None).otherwise(F.col(c)).alias(c) if c in (target, "filled_by") else F.col(c) for c in filled.columns))


def reconcile(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rules by what a new learning does to them: kept, retired, added."""
    a, b = (x.select("rule_id").distinct().withColumn(n, F.lit(True)) for x, n in ((old, "o"), (new, "n")))
    state = F.when(F.col("o") & F.col("n"), "kept").when(F.col("o"), "retired").otherwise("added")
    return a.join(b, "rule_id", "full_outer").select("rule_id", state.alias("change"))


def preview(df: DataFrame, matches: Column, target: str, value) -> DataFrame:
    """What a rule would do: rows it matches, would fill, finds filled alike, and would overwrite."""
    new, same = F.col(target).isNull(), F.col(target).cast("string") == F.lit(str(value))
    one = lambda c: F.count(F.when(c, 1))
    return df.where(matches).agg(F.count("*").alias("matched"), one(new).alias("would_fill"), one(same).alias("already"), one(~new & ~same).alias("would_overwrite"))


def prefix_patterns(df: DataFrame, column: str, flag: Column, length: int, least: int) -> DataFrame:
    """Prefixes by how evenly they split flagged rows from the rest: c (1 - c), c the share of flagged rows they hold."""
    base = df.where(F.length(column) >= length).select(F.substring(column, 1, length).alias("prefix"), flag.cast("int").alias("f"))
    counted = base.groupBy("prefix").agg(F.count("*").alias("n"), F.sum("f").alias("k"))
    total = counted.agg(F.sum("k").alias("all_k"))
    share = F.when(F.col("all_k") > 0, F.col("k") / F.col("all_k")).otherwise(0.0)
    return counted.where(F.col("n") >= least).join(F.broadcast(total)).select("prefix", "n", "k", F.round(share * (1 - share), 6).alias("rank_score"))


def proposals(df: DataFrame, keys: Sequence[str], anchor: str, least: int = 2) -> DataFrame:
    """Keys whose anchored rows all name one value, with their open rows: values that could be proposed."""
    grouped = df.groupBy(*keys).agg(F.count(anchor).alias("anchors"), F.countDistinct(anchor).alias("kinds"), F.min(F.col(anchor).cast("string")).alias("proposed"), F.count(F.when(F.col(anchor).isNull(), 1)).alias("open_rows"))
    return grouped.where((F.col("anchors") >= least) & (F.col("kinds") == 1) & (F.col("open_rows") > 0)).select(*keys, "proposed", "anchors", "open_rows")
