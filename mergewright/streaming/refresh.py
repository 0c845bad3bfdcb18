"""The state operators as Structured Streaming: latest values, deduplication and windows over rows that arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import upsert


def read_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of a folder, with the schema of those there."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def windowed_counts(events: DataFrame, at: str, by: list[str], window: str, late: str) -> DataFrame:
    """Counts by event-time window; rows later than `late` are not counted any more."""
    w = F.window(at, window)
    return events.withWatermark(at, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def deduplicated(events: DataFrame, key: list[str], at: str, late: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def upsert_into(path_of: Callable[[int], str], key: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes version n+1 of a table from version n and the batch's rows.

    path_of(n) is the folder of version n; a batch that runs again overwrites its own version, so it has its effect once.
    """

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(path_of(n))
        upsert(old, batch.select(*old.columns), key).drop("change").write.mode("overwrite").parquet(path_of(n + 1))

    return run
