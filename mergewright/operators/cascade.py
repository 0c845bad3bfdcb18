"""Resolving in ordered stages, where a row that one stage decides goes no further.

A stage decides a row by rules that have its keys. Rules whose guard fails count as refused. One target left resolves the
row, several leave it ambiguous, and both end its way; where none is left the row travels on, and its trace says whether the
stage had nothing for it or refused what it had. A stage without rules is a test that ends a row's way (a terminal).

Rows are told apart by their key column; rows of one key take one way. A null in a key column of a row or rule meets
nothing; a null test or guard doesn't hold. What each stage leaves open is written once, so a stage costs what is still open.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored


@dataclass(frozen=True)
class Stage:
    """rules: target and one column for each key, named by `keys` (rule column to an expression of the row); guard: a
    condition on row and rule columns (rules' as r_<name>). Or a test of the row alone."""

    name: str
    rules: DataFrame | None = None
    keys: dict[str, Column] = field(default_factory=dict)
    guard: Column | None = None
    test: Column | None = None


def _decisions(rows: DataFrame, key: str, stage: Stage) -> DataFrame:
    """key, __n (targets left), __target and __refused (some rule, but none left) of the rows that the stage's rules meet."""
    keyed = rows.withColumns({f"__k_{c}": e for c, e in stage.keys.items()})
    rules = stage.rules.select(*(F.col(c).alias(f"r_{c}") for c in stage.rules.columns)).distinct()
    on = [F.col(f"__k_{c}") == F.col(f"r_{c}") for c in stage.keys]
    met = keyed.join(rules, on)
    passes = F.lit(True) if stage.guard is None else F.coalesce(stage.guard, F.lit(False))
    left = F.when(passes, F.col("r_target"))
    return met.groupBy(key).agg(F.countDistinct(left).alias("__n"), F.min(left).alias("__target"))


def resolve(rows: DataFrame, key: str, stages: Sequence[Stage]) -> DataFrame:
    """key, branch (the stage that decided, or null), outcome (resolved, ambiguous, terminal or unresolved), target and trace
    (stage:what it found, in order) of each row key."""
    names = [s.name for s in stages]
    if len({*names}) < len(names) or any((s.rules is None) == (s.test is None) for s in stages):
        raise ValueError("stages need names of their own, and either rules or a test each")
    open_ = rows.dropDuplicates([key]).withColumn("trace", F.array().cast("array<string>"))
    done = []
    for s in stages:
        if s.rules is None:
            found = open_.withColumns({"__what": F.when(F.coalesce(s.test, F.lit(False)), "terminal").otherwise("none"), "__target": F.lit(None).cast("string")})
        else:
            told = F.when(F.col("__n").isNull(), "none").when(F.col("__n") == 0, "refused").when(F.col("__n") == 1, "resolved").otherwise("ambiguous")
            found = open_.join(_decisions(open_, key, s), key, "left").withColumn("__what", told).drop("__n")
        found = stored(found.withColumn("trace", F.array_append("trace", F.concat(F.lit(f"{s.name}:"), F.col("__what")))))
        ended = F.col("__what").isin("resolved", "ambiguous", "terminal")
        done.append(found.where(ended).select(key, F.lit(s.name).alias("branch"), F.col("__what").alias("outcome"), F.when(F.col("__what") == "resolved", F.col("__target").cast("string")).alias("target"), "trace"))
        open_ = found.where(~ended).drop("__what", "__target")
    out = open_.select(key, F.lit(None).cast("string").alias("branch"), F.lit("unresolved").alias("outcome"), F.lit(None).cast("string").alias("target"), "trace")
    for d in done:
        out = out.unionByName(d)
    return out
