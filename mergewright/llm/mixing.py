"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a cap of so many epochs of its own size. The budget is shared by weight; a source above its
cap is clamped there and what it can't use is shared among the others by weight, until none is above: round by round over
the table of sources, of which only sums reach the driver.

A target of r epochs takes every document floor(r) times and, of the rest, the documents that come first in the order of
md5(seed:doc_id), up to the fraction left; the last of them is the one whose middle still lies within that fraction. The
order's cut is found without sorting a source: sizes are summed by the first four hex digits of the hash, and only
documents of the digits where the cut falls are ordered. Each source ends within one document of its target, and the
same seed gives the same mix.

Cases: a null text has size 0; a null source is a source of its own, last in order; a null doc_id hashes as an empty
text; rows with equal hashes in a source (repeated rows, repeated ids) are taken or left together; documents without
words never matter, and are kept as often as whole repetitions say; an empty table gives an empty mix. Further columns of
any name are carried; repeats() refuses those that its results have. There may be as
many sources as rows: the plan has a row per source and is broadcast only when it has at most BROADCAST_SOURCES.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Up to so many sources (about 100 bytes each) the plan is broadcast; more are joined by shuffles, split where skewed.
BROADCAST_SOURCES = 50_000
DIGITS = 4


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)).cast("long"), F.lit(0).cast("long"))


def hash_of(seed: int, doc_id: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))


def cycle_weight(rank: Column, weights: tuple[int, ...]) -> Column:
    """The weights in turn, by a rank that begins with 1."""
    return F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))


def ranked(sizes: DataFrame) -> DataFrame:
    """sizes with rank: the place of each source in their order, null last, counted range by range."""
    parts = sizes.repartitionByRange(F.col("source").isNull(), "source").withColumn("range", F.spark_partition_id())
    parts = common.stored(parts, "mix-ranges")
    counts, before, rows = sorted(map(tuple, parts.groupBy("range").count().collect())), 0, []
    for part, n in counts:
        rows.append((part, before))
        before += n
    # As an Arrow table, which needs no Python workers of its own beside those that stay for Arrow functions.
    offsets = sizes.sparkSession.createDataFrame(pa.table({k: pa.array(v, t) for k, v, t in (("range", [r[0] for r in rows], pa.int32()), ("before", [r[1] for r in rows], pa.int64()))}), "range int, before long")
    order = Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())
    return parts.join(F.broadcast(offsets), "range").withColumn("rank", (F.col("before") + F.row_number().over(order)).cast("long")).drop("range", "before")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: tuple[int, int], epochs: int) -> DataFrame:
    """source, source_size, weight and target of each source of (source, source_size).

    share: the budget as a fraction of all sizes. The level, what a weight of 1 gets, rises while sources are clamped that
    it fills above their cap; each round is an aggregate over the sources.
    """
    x = ranked(sizes).withColumn("weight", cycle_weight(F.col("rank"), weights).cast("long")).withColumn("cap", F.col("source_size") * epochs)
    x = common.stored(x.select("source", "source_size", "weight", "cap"), "mix-caps")
    total = x.agg(F.sum("source_size")).first()[0] or 0
    budget, level, clamped = total * share[0] / share[1], -1.0, None
    while True:
        full = F.col("cap") / F.col("weight") <= level
        r = x.agg(F.count_if(full).alias("n"), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)).alias("held"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("open")).first()
        if r.n == clamped or not r.open:
            break
        clamped, level = r.n, (budget - r.held) / r.open
    cap = F.col("cap").cast("double")
    return x.select("source", "source_size", "weight", F.when(full, cap).otherwise(F.least(cap, F.lit(level) * F.col("weight"))).alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), epochs: int = 2, seed: int = 17) -> DataFrame:
    """A row per source of docs (doc_id, source, size, hash): source, source_size, target, whole (repetitions of every
    document) and cut (documents whose hash is at most this are taken once more; null: none)."""
    cells = docs.groupBy("source", F.substring("hash", 1, DIGITS).alias("cell")).agg(F.sum("size").alias("cell_size"))
    per_source = cells.groupBy("source").agg(F.sum("cell_size").alias("source_size"))
    goals = targets(per_source, weights, share, epochs)
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    goals = common.stored(goals.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-goals")
    if goals.count() <= BROADCAST_SOURCES:
        goals = F.broadcast(goals)
    run = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    before = cells.withColumn("start", F.sum("cell_size").over(run) - F.col("cell_size"))
    edge = before.join(goals.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    edge = edge.where("start < rest")
    # The last cell that begins below the rest holds the cut.
    last = edge.groupBy("source").agg(F.max(F.struct("cell", "start", "rest")).alias("e")).select("source", "e.*")
    last = common.stored(last, "mix-edges")
    if last.count() <= BROADCAST_SOURCES:
        last = F.broadcast(last)
    near = docs.join(last.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")) & (F.substring("hash", 1, DIGITS) == F.col("cell"))).drop("s")
    ties = near.groupBy("source", "hash", "start", "rest").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("hash").rowsBetween(Window.unboundedPreceding, 0))
    taken = ties.withColumn("middle", 2 * (F.col("start") + upto) - F.col("size")).where(F.col("middle") < 2 * F.col("rest"))
    cut = taken.groupBy("source").agg(F.max("hash").alias("inner_cut"))
    cut = last.join(cut.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), F.coalesce("inner_cut", "cell").alias("cut"))
    out = goals.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "whole", "cut")
    return common.stored(out, "mix-plan")


def repeats(df: DataFrame, mix: DataFrame, seed: int = 17, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """df with mix_source_size, mix_target and repeats: how often the mix takes each row."""
    if clash := {"mix_source_size", "mix_target", "repeats", "__source", "__whole", "__cut"} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns clash with results: {sorted(clash)}")
    side = mix.select(F.col("source").alias("__source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("whole").alias("__whole"), F.col("cut").alias("__cut"))
    if mix.count() <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    once_more = F.coalesce(hash_of(seed, doc_id) <= F.col("__cut"), F.lit(False)).cast("int")
    joined = df.join(side, F.col(source).eqNullSafe(F.col("__source")), "left")
    return joined.select(*[df[c] for c in df.columns], "mix_source_size", "mix_target", (F.col("__whole") + once_more).alias("repeats"))


def slim(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, source, size and hash of each document."""
    return docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), hash_of(seed, "doc_id").alias("hash"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), epochs: int = 2, seed: int = 17) -> DataFrame:
    """The mixed corpus: each row of docs as often as its repetitions say, with docs' columns."""
    whole = docs.select("doc_id", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole_row"))
    rows = repeats(whole, plan(common.stored(slim(docs, seed), "mix-sizes"), weights, share, epochs, seed), seed)
    return rows.where("repeats > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select("whole_row.*")
