"""Files of other systems as DataFrames, and writes that are reconciled before they count."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_to_null


def fixed_width(lines: DataFrame, layout: Mapping[str, tuple[int, int]], length: int, marker: tuple[int, str] | None = None, line: str = "value") -> DataFrame:
    """Fields cut from lines by (position from 0, length), blanks as null, and malformed: the reason where a line's length
    or table marker is wrong. A malformed line has no fields.
    """
    raw = F.rtrim(F.col(line), F.lit("\r"))
    wrong = F.when(F.length(raw) != length, "length")
    if marker is not None:
        at, value = marker
        wrong = F.coalesce(wrong, F.when(F.substring(raw, at + 1, len(value)) != value, "marker"))
    cut = lambda at, n: F.when(F.col("malformed").isNull(), blank_to_null(F.substring(raw, at + 1, n)))
    return lines.withColumn("malformed", wrong).select(*(cut(at, n).alias(name) for name, (at, n) in layout.items()), "malformed")


def read_fixed_width(spark: SparkSession, path: str, layout: Mapping[str, tuple[int, int]], length: int, marker: tuple[int, str] | None = None, encoding: str = "ISO-8859-1") -> DataFrame:
    lines = spark.read.option("encoding", encoding).option("header", False).option("sep", "\u0001").option("quote", "").schema("value string").csv(path)
    return fixed_width(lines, layout, length, marker)


def to_fixed_width(df: DataFrame, layout: Mapping[str, tuple[int, int]], length: int) -> Column:
    """The line that the layout gives a row: values left-aligned and cut to their place."""
    parts, at = [], 0
    for name, (start, n) in sorted(layout.items(), key=lambda x: x[1]):
        if start > at:
            parts.append(F.lit(" " * (start - at)))
        parts.append(F.rpad(F.coalesce(F.col(name).cast("string"), F.lit("")), n, " "))
        at = start + n
    return F.concat(*parts, F.lit(" " * (length - at)))


def read_entities(spark: SparkSession, path: str, tag: str, fields: Mapping[str, str]) -> DataFrame:
    """XML entities <tag ID=..><Value AttributeID=..>text</Value>..</tag> with the attributes of `fields` as columns."""
    schema = "_ID string, Value array<struct<_AttributeID: string, _VALUE: string>>"
    raw = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    pairs = F.map_from_entries(F.array_distinct(F.transform("Value", lambda v: F.struct(v["_AttributeID"].alias("k"), v["_VALUE"].alias("v")))))
    return raw.select(F.col("_ID").alias("entity_id"), pairs.alias("__m")).select("entity_id", *(blank_to_null(F.col("__m")[a]).alias(c) for a, c in fields.items()))


def pivot_attributes(rows: DataFrame, key: Sequence[str], attribute: str, value: str, fields: Sequence[str]) -> DataFrame:
    """Entity-attribute rows as one row per entity; of several values of an attribute the greatest."""
    return rows.groupBy(*key).agg(*(F.max(F.when(F.col(attribute) == f, F.col(value))).alias(f) for f in fields))


def land(df: DataFrame, path: str, declared: int) -> int:
    """Write df beside path, count what was written, and only then let it count as landed.

    The rows go to a folder of their own below path, and a marker in path/_landed names the folder once the declared, the
    written and the read count agree; otherwise ValueError, and readers never see the folder.
    """
    spark = df.sparkSession
    batch = uuid.uuid4().hex
    df.write.parquet(f"{path}/batch={batch}")
    landed = spark.read.parquet(f"{path}/batch={batch}").count()
    if landed != declared:
        raise ValueError(f"{declared} rows were declared, {landed} landed")
    spark.createDataFrame([(batch, landed)], "batch string, rows long").coalesce(1).write.mode("append").parquet(f"{path}/_landed")
    return landed


def landed(spark: SparkSession, path: str) -> DataFrame:
    """All rows of batches that are marked as landed."""
    batches = [r.batch for r in spark.read.parquet(f"{path}/_landed").select("batch").distinct().collect()]
    return spark.read.option("basePath", path).parquet(*(f"{path}/batch={b}" for b in batches))
