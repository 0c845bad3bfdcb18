"""Rows that speak for a key: latest, survivors, changes, intervals, samples, pages and fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def latest_values(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """As latest(), by an aggregate that combines before the shuffle: the greatest (order, values) of each key."""
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *values)).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in (*order, *values)))


def survivors(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Each row of a key with its rank and whether it survives; rows without a key all do."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("rank", rank).withColumn("survives", F.col(key).isNull() | (F.col("rank") == 1))


def changes(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before it; the first of a key counts as a change."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("before", before).where(~F.col(value).eqNullSafe(F.col("before")))


def intervals(df: DataFrame, key: str, start: str, tie: str, value: str) -> DataFrame:
    """Validity intervals: equal neighbours are one, each ends where the next begins, the last is open."""
    changed = changes(df, key, [start, tie], value)
    end = F.lead(start).over(Window.partitionBy(key).orderBy(start, tie))
    return changed.select(key, value, F.col(start).alias("valid_from"), end.alias("valid_to"), end.isNull().alias("is_current"))


def seeded_sample(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """n rows in the order of md5(seed|key): the same for the same seed."""
    return df.withColumn("draw", F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")).cast("binary"))).orderBy("draw", key).limit(n)


def stratified_sample(df: DataFrame, stratum: Sequence[str], key: str, seed: str, n: int) -> DataFrame:
    """Up to n rows of each stratum in the seeded order."""
    drawn = df.withColumn("draw", F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")).cast("binary")))
    return latest_n(drawn, stratum, ["draw", key], n)


def latest_n(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def page_after(df: DataFrame, key: str, cursor, n: int) -> DataFrame:
    """The next n rows behind a cursor, in order of the key."""
    return df.where(F.col(key) > F.lit(cursor)).orderBy(key).limit(n)


def seek(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, right_at: str, values: Sequence[str]) -> DataFrame:
    """For each left row the first right row of its keys at or after its place; nulls where there is none.

    Both sides are one sorted sequence by key, and the next right row is carried backwards over it: no pairs are made.
    """
    l_cols, none = left.columns, F.lit(None)
    l_rows = left.select(*keys, F.col(at).alias("__at"), F.lit(0).alias("__side"), F.struct(*l_cols).alias("__left"), none.cast(right.select(F.struct(right_at, *values)).schema[0].dataType).alias("__right"))
    r_rows = right.select(*keys, F.col(right_at).alias("__at"), F.lit(1).alias("__side"), none.cast(left.select(F.struct(*l_cols)).schema[0].dataType).alias("__left"), F.struct(right_at, *values).alias("__right"))
    order = Window.partitionBy(*keys).orderBy("__at", "__side").rowsBetween(0, Window.unboundedFollowing)
    seen = l_rows.unionByName(r_rows).withColumn("__next", F.first("__right", ignorenulls=True).over(order)).where("__side = 0")
    return seen.select("__left.*", *(F.col(f"__next.{c}").alias(c) for c in (right_at, *values)))


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A content fingerprint that ignores order and adds up over parts: rows, and the sums of both halves of each row's md5."""
    digest = F.md5(F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns)).cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("n_rows"), F.sum(half(1)).cast("string").alias("high"), F.sum(half(17)).cast("string").alias("low"))


def signature(*columns: str) -> Column:
    """A stable key of several values."""
    return F.sha2(F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)


def exact_text(*columns: str) -> Column:
    """Several values as one text that no other values have: each with its length before it, a null by a mark of its own."""
    one = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.concat(*(one(F.col(c).cast("string")) for c in columns))


def exact_signature(*columns: str) -> Column:
    """A key of several values that tells null from empty text and one split of a text from another."""
    return F.sha2(exact_text(*columns), 256)
