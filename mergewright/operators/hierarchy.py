"""Catalogues with levels, references with dates, lists in text, and descriptions by language."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null


def assembled(levels: Sequence[tuple[DataFrame, str, str | None, str]], leaves: DataFrame, deleted: str | None = None, strict: bool = False) -> DataFrame:
    """The lowest level's rows with the ids and names on their way down, and how many leaves hang below each.

    levels: (rows, id, parent's id or None, name) from the top on; ids are known by their column names, which the next level
    and the leaves use. Rows are told apart by id, whatever their names. Rows whose column `deleted` is true are dropped, and
    what hangs below them with them. A parent's id or a leaf's id that names no row is missing: its row is kept with missing
    true and null names, or ends the job where strict. Null ids of leaves are missing too.
    """
    alive = lambda df: df.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted and deleted in df.columns else df
    gone = lambda df: df.where(F.coalesce(F.col(deleted), F.lit(False))) if deleted and deleted in df.columns else df.where(F.lit(False))
    rows, key, _, name = levels[0]
    out, dropped = alive(rows).select(key, name).withColumn("missing", F.lit(False)), gone(rows).select(key)
    for rows, own, parent, own_name in levels[1:]:
        below = alive(rows).select(own, parent, own_name).join(dropped, parent, "left_anti")
        dropped = gone(rows).select(own).unionByName(alive(rows).join(dropped, parent, "left_semi").select(own))
        out = below.join(out, parent, "left").withColumn("missing", F.coalesce("missing", F.lit(True)))
        key = own
    counted = leaves.join(dropped, key, "left_anti").groupBy(key).agg(F.count("*").alias("n_leaves"))
    counted = counted.withColumnRenamed(key, "__leaf")
    joined = out.join(counted, F.col(key) == F.col("__leaf"), "full_outer")
    joined = joined.withColumn(key, F.coalesce(key, "__leaf")).withColumns({"missing": F.coalesce("missing", F.lit(True)), "n_leaves": F.coalesce("n_leaves", F.lit(0))})
    ids, names = [x[1] for x in levels], [x[3] for x in levels]
    if strict:
        joined = joined.withColumn("missing", F.when(F.col("missing"), F.raise_error(F.concat(F.lit(f"{key} has a missing reference: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(F.lit(False)))
    return joined.select(*ids, *names, "n_leaves", "missing")


def described(rows: DataFrame, descriptions: DataFrame, key: str, language: str) -> DataFrame:
    """rows with the description in the language, and whether one is missing (which a strict reader refuses)."""
    own = descriptions.where(F.col("lang") == language).groupBy(key).agg(F.min("description").alias("description"))
    return rows.join(own, key, "left").withColumn("missing", F.col("description").isNull())


def listed(c: Column) -> Column:
    """The parts of a list with commas, trimmed, without empty ones, each once and in order of first appearance."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), blank_to_null), lambda x: x.isNotNull()))


def encode_ref(source: Column, ref: Column, day: Column) -> Column:
    """source[:ref][@date]."""
    return F.concat(source, F.coalesce(F.concat(F.lit(":"), blank_to_null(ref)), F.lit("")), F.coalesce(F.concat(F.lit("@"), F.date_format(day, "yyyy-MM-dd")), F.lit("")))


def parse_ref(c: Column) -> Column:
    """(source, ref, day) of source[:ref][@date]; parts that aren't there are null."""
    part = lambda i: F.nullif(F.regexp_extract(c, r"^([^:@]+)(?::([^@]*))?(?:@([0-9]{4}-[0-9]{2}-[0-9]{2}))?$", i), F.lit(""))
    return F.struct(part(1).alias("source"), part(2).alias("ref"), F.try_to_date(part(3), "yyyy-MM-dd").alias("day"))


def seek_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """n seek keys at equal distances over a space of whole numbers, each with the first key at or after it.

    Each key falls behind the last seek at or before it, by arithmetic; the least key behind each seek is an aggregate, and
    the least at or after it runs over those n rows. Null keys count nowhere; an empty table has no seeks.
    """
    whole = df.where(F.col(key).isNotNull()).select(F.col(key).cast("decimal(38,0)").alias("__k"))
    low, high = whole.agg(F.min("__k"), F.max("__k")).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "seek long, first_key long")
    low, span = int(low), int(high) - int(low)
    # The last i with (span * i) div n <= k - low, that is span * i < (k - low + 1) * n.
    last = F.expr(f"((__k - {low}BD + 1) * {n} - 1) div {max(span, 1)}BD")
    each = whole.groupBy(F.least(last, F.lit(n - 1)).alias("i")).agg(F.min("__k").alias("k"))
    seeks = df.sparkSession.createDataFrame([(i, low + span * i // n) for i in range(n)], "i long, seek long")
    after = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    found = seeks.join(F.broadcast(each), "i", "left").withColumn("behind", F.min("k").over(after))
    # Where two seeks are one key, what lies behind the later one stands at the earlier too.
    return found.select("seek", F.col("behind").cast("long").alias("first_key"))
