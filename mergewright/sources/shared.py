"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: The temporary folder of each application that names no shared one.
_own: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new name below spark.checkpoint.dir, a folder that all machines share; where that setting is missing a temporary
    folder serves on a single machine (a local master, as in tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _own.get(app) or _own.setdefault(app, Path(tempfile.mkdtemp(prefix="spark-mergewright-")).as_uri())
    return f"{base.rstrip('/')}/mergewright/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, which cuts its lineage."""
    spark = df.sparkSession
    path = shared_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
