"""What the training-data operators share: folders that every machine sees, batches of bounded size, words."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and the five control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch that goes to Python; texts reach 100 kB and more, so a batch stays at a few hundred of them.
BATCH_ROWS = 500
#: Labels (16 bytes each) that are broadcast at most; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and keep Arrow batches small.

    Workers get the package's folder through PYTHONPATH; where the package is installed on every machine that changes
    nothing.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: The temporary folder of each application that names no shared one.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; as a URI.

    Where that setting is missing on a single machine (a local master, as in tests) a temporary folder of it serves;
    elsewhere that is an error. A setting without a scheme lies in Hadoop's default file system.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _own.get(app) or _own.setdefault(app, Path(tempfile.mkdtemp(prefix="spark-mergewright-")).as_uri())
    if base.startswith("/"):
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        base = ("file://" if default.startswith("file:") else default.rstrip("/")) + base
    return f"{base.rstrip('/')}/mergewright/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in a shared folder and read back: its lineage ends there, and a lost executor costs nothing."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table that stored() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let_go(spark: SparkSession) -> None:
    """Let the driver collect what it doesn't use any more. Spark removes a shuffle's files from the executors' disks when its
    table is collected, which on an idle driver may be long after the result was stored. Python's freed memory, of tables that
    were fetched, goes back to the machine."""
    give_back()
    # The JVM hears of what Python has dropped from a thread of its own.
    time.sleep(1)
    spark._jvm.System.gc()


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Meanwhile Spark removes the files of a query's shuffles as soon as the query has ended, not when the driver happens to
    collect its plan. For queries whose result is stored or fetched."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def filesystem(uri: str):
    """The pyarrow file system of a URI and the path in it; made inside tasks, for it can't be pickled."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def hash_sample(df: DataFrame, column: str, n: int) -> DataFrame:
    """n rows of df (all, where it has fewer) in the order of a hash of a column, ties by the other columns.

    Rows are counted first, and only those below a share of the hash's range, of which there are some more than n, are
    ordered; so the last step's work doesn't grow with the table.
    """
    total = df.count()
    drawn = df.withColumn("__draw", F.shiftrightunsigned(F.xxhash64(column), 1))
    if total > 1.2 * n:
        drawn = drawn.where(F.col("__draw") < int(1.2 * n / total * 2**63))
    return drawn.orderBy("__draw", *df.columns).limit(n).drop("__draw")


def most_frequent(df: DataFrame, n: str, most: int) -> DataFrame:
    """The rows of df with the highest counts, at most `most` of them: all rows from a count on, where that count is chosen by
    a histogram of a few hundred bins; so equal counts stay or go together and nothing is ordered."""
    bin_ = F.floor(F.log2(F.col(n).cast("double")) * 8)
    at, have = None, 0
    for r in sorted(df.where(F.col(n) > 0).groupBy(bin_.alias("bin")).count().collect(), key=lambda r: -r["bin"]):
        have += r["count"]
        if have > most:
            break
        at = r["bin"]
    return df.where(F.lit(False)) if at is None else df.where(bin_ >= at)


def labelled_sample(docs: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """doc_id, y and text of at most n labelled rows outside the held-out third (crc32 of the id mod 3 is 1), in the order of
    a hash of id, label and text; of rows alike in all three one counts. The bound is one of rows, whatever ids repeat."""
    key = F.xxhash64("doc_id", "__y", "text")
    wanted = hash_sample(stored(labelled(docs, labels).select(key.alias("__want")).distinct(), "labelled"), "__want", n)
    some = labelled(docs, labels).withColumn("__key", key).join(F.broadcast(wanted), F.col("__key") == F.col("__want"))
    return some.groupBy("__key").agg(*(F.first(c).alias(c) for c in ("doc_id", "__y", "text"))).drop("__key")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, __y and text of the labelled documents outside the held-out third (crc32 of the id mod 3 is 1)."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(F.pmod(id_crc(), F.lit(3)) != 1)
    known = known.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__y"))
    if known.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    return docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("__id")).select("doc_id", "__y", "text")


def text_of(name: str = "text") -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def id_crc(name: str = "doc_id") -> Column:
    """crc32 of the id as decimal text, by which folds are dealt; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")))


def texts(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an Arrow column, null as empty, and where each begins (one place more than texts)."""
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(text: str) -> list[bytes]:
    """The words of a text as UTF-8; bytes.split() cuts at exactly the six separators."""
    return text.encode().split()


def lower_words(text: str) -> list[bytes]:
    """Words with A-Z in lower case; bytes.lower() leaves all other letters alone."""
    return text.encode().lower().split()


def one_batch(columns: dict[str, pa.Array | list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip((columns[f.name] for f in schema), schema, strict=True)], schema=schema)


def give_back() -> None:
    """Return to the machine what earlier tasks of this Python worker have freed; workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the column's bytes stay near `most` in each (a single longer text comes alone)."""
    import pyarrow.compute as pc

    give_back()
    for b in batches:
        total = b.column(column).nbytes
        if total <= most or b.num_rows < 2:
            yield b
            continue
        sizes = [x or 0 for x in pc.binary_length(b.column(column)).to_pylist()]
        start = have = 0
        for i, n in enumerate(sizes):
            if i > start and have + n > most:
                yield b.slice(start, i - start)
                start, have = i, 0
            have += n
        yield b.slice(start)
