"""Sorted-string-table shards of token ids.

A shard holds documents in ascending order of their identifier. Its entries lie in blocks of about BLOCK bytes; in a
block each key is stored as the length it shares with the key before it and the rest (prefix compression), followed by
its value, the ids as little-endian numbers of 2 or 4 bytes. After the blocks come the sparse index (last key, place and
size of each block), a Bloom filter over the keys and a footer of fixed size, so a reader finds a key with a binary
search in the index and one range read.

    block   crc32, raw size (4 bytes each), zstd of: (shared, rest, value size as varints, rest of key, value)...
    index   per block: key size, key, offset, size, entries
    footer  index offset and size, Bloom offset and size, entries, ids, width of an id, number of hashes, magic

Shards are made by a range partitioning on the identifier: only whole numbers per shard (ids, keys, entries) reach the
driver, which lays the shards end to end. A shard is written under a name of its own attempt and then renamed, so a task
that runs again replaces it whole.

Cases: a null identifier sorts first and is a key of its own; repeated identifiers are entries of their own, in order of
a hash of their text, so that several shards can share them, and a lookup returns all of them; a null or empty text has only its end id; a long text is a block by itself;
an empty table makes no shard and reads back as no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common

BLOCK = 64 << 10
BITS_PER_KEY, HASHES = 10, 7
FOOTER = struct.Struct("<QQQQQQHH8s")
MAGIC = b"mwsst\x00\x01\n"
#: Entries of a shard are read back in groups of so many ids.
READ_IDS = 1 << 20


def key_of(doc_id: int | None) -> bytes:
    """A key that sorts as the identifier does, null first."""
    return b"\x00" if doc_id is None else b"\x01" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _bloom_places(keys: list[bytes], bits: int) -> np.ndarray:
    h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<u8")
    a, b = h[0::2, None], h[1::2, None] | np.uint64(1)
    return (a + b * np.arange(HASHES, dtype=np.uint64)) % np.uint64(bits)


class Writer:
    """Writes one shard to an open stream; keys must come in order."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.entries = self.ids = 0
        self.keys: list[bytes] = []
        self.index: list[tuple[bytes, int, int, int]] = []
        self._new()

    def _new(self) -> None:
        self.parts, self.size, self.last, self.count = [], 0, b"", 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = next((i for i, (a, b) in enumerate(zip(key, self.last, strict=False)) if a != b), min(len(key), len(self.last)))
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.parts += [entry, value]
        self.size += len(entry) + len(value)
        self.last, self.count = key, self.count + 1
        self.entries += 1
        self.ids += len(value) // self.width
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        if self.size >= BLOCK:
            self._flush()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _flush(self) -> None:
        if self.count:
            raw = b"".join(self.parts)
            packed = pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)
            start = self.at
            self._put(struct.pack("<II", zlib.crc32(raw), len(raw)) + packed)
            self.index.append((self.last, start, self.at - start, self.count))
            self._new()

    def close(self) -> None:
        self._flush()
        index_at = self.at
        self._put(b"".join(struct.pack("<H", len(k)) + k + struct.pack("<QII", *rest) for k, *rest in self.index))
        bloom_at = self.at
        bits = max(64, len(self.keys) * BITS_PER_KEY + 7 & ~7)
        flags = np.zeros(bits, bool)
        for i in range(0, len(self.keys), 100_000):
            flags[_bloom_places(self.keys[i : i + 100_000], bits).ravel()] = True
        self._put(np.packbits(flags, bitorder="little").tobytes())
        self._put(FOOTER.pack(index_at, bloom_at - index_at, bloom_at, self.at - bloom_at, self.entries, self.ids, self.width, HASHES, MAGIC))


class Reader:
    """One shard, of which only the footer, the index and the Bloom filter are held; blocks are read when asked for."""

    def __init__(self, uri: str):
        fs, path = common.filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        index_at, index_size, bloom_at, bloom_size, self.entries, self.ids, self.width, _, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        raw, at, self.index = self.file.read_at(index_size, index_at), 0, []
        while at < len(raw):
            n = struct.unpack_from("<H", raw, at)[0]
            self.index.append((raw[at + 2 : at + 2 + n], *struct.unpack_from("<QII", raw, at + 2 + n)))
            at += 2 + n + 16
        self.last_keys = [x[0] for x in self.index]
        self.bloom = np.frombuffer(self.file.read_at(bloom_size, bloom_at), np.uint8)

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, start, size, _ = self.index[i]
        data = self.file.read_at(size, start)
        crc, n = struct.unpack_from("<II", data)
        raw = pa.Codec("zstd").decompress(data[8:], n, asbytes=True)
        if zlib.crc32(raw) != crc:
            raise ValueError(f"block {i} is damaged")
        at, key = 0, b""
        while at < n:
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            value, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, raw[at : at + value]
            at += value

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def may_hold(self, key: bytes) -> bool:
        p = _bloom_places([key], len(self.bloom) * 8)[0].astype(np.int64)
        return bool((self.bloom[p >> 3] >> (p & 7) & 1).all())

    def lookup(self, key: bytes) -> list[bytes]:
        """The values under a key: none, one, or more where an identifier is repeated."""
        if not self.may_hold(key):
            return []
        found = []
        for i in range(bisect_left(self.last_keys, key), len(self.index)):
            hits = [v for k, v in self.block(i) if k == key]
            found += hits
            if self.last_keys[i] != key:
                break
        return found


def write_shards(docs: DataFrame, path: str, model: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each text, append end_id and write the shards below path; the shards' list is returned, in order.

    The list (shard, file, entries, ids, start, first and last key) has a row per shard.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    width = 2 if max(len(bpe.token_table(model)), end_id + 1) <= 1 << 16 else 4
    code = "H" if width == 2 else "I"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe._worker(hash((sent.value, width)), lambda: bpe.PieceEncoder(sent.value, code, bpe.KEPT_ALONE))
        shard = TaskContext.get().partitionId()
        fs, folder = common.filesystem(path)
        fs.create_dir(folder, recursive=True)
        name, end = f"shard-{shard:06d}.sst", array(code, [end_id]).tobytes()
        own = f"{folder}/.{name}-{uuid.uuid4().hex}"
        writer, first, key, out = None, b"", b"", None
        for b in common.sliced(batches, "text", 1 << 20):
            for doc, ids in zip(b.column(0).to_pylist(), encoder(common.texts(b.column(1))), strict=True):
                key = key_of(doc)
                if writer is None:
                    out = fs.open_output_stream(own)
                    writer, first = Writer(out, width), key
                writer.add(key, ids + end)
        if writer is None:
            return
        writer.close()
        out.close()
        fs.move(own, f"{folder}/{name}")
        yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [f"{path}/{name}"], "entries": [writer.entries], "ids": [writer.ids], "first_key": [first], "last_key": [key]})

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # An identifier of many rows (null is one) would go to one task by itself: a hash of the text deals them out, and rows that
    # are alike in both, which any order suits, a number of their own.
    own = own.withColumns({"__hash": F.xxhash64("text"), "__row": F.monotonically_increasing_id()})
    sorted_docs = own.repartitionByRange("doc_id", "__hash", "__row").sortWithinPartitions("doc_id", "__hash", "text").select("doc_id", "text")
    made = sorted_docs.mapInArrow(run, "shard long, file string, entries long, ids long, first_key binary, last_key binary").collect()
    start, rows = 0, []
    for r in sorted(made, key=lambda r: r.shard):
        rows.append((r.shard, r.file, r.entries, r.ids, start, bytes(r.first_key), bytes(r.last_key)))
        start += r.ids
    return _spread(spark, rows, "shard long, file string, entries long, ids long, start long, first_key binary, last_key binary")


def _spread(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Few rows, each in a partition of its own."""
    return spark.createDataFrame(rows, schema).repartition(max(1, len(rows)))


def read_shards(shards: DataFrame) -> DataFrame:
    """Every entry of the shards: doc_id, start (ids before it) and its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                reader = Reader(file)
                docs, starts, values, have = [], [], [], 0
                for key, value in reader:
                    ids = np.frombuffer(value, f"<u{reader.width}").astype(np.uint32)
                    docs.append(id_of(key))
                    starts.append(start)
                    values.append(ids)
                    start += len(ids)
                    have += len(ids)
                    if have >= READ_IDS:
                        yield _ids_batch(docs, starts, values)
                        docs, starts, values, have = [], [], [], 0
                if docs:
                    yield _ids_batch(docs, starts, values)

    return shards.select("file", "start").mapInArrow(run, "doc_id long, start long, ids array<long>")


def _ids_batch(docs: list, starts: list, values: list[np.ndarray]) -> pa.RecordBatch:
    at = pa.array(np.cumsum([0, *map(len, values)]), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.ListArray.from_arrays(at, pa.array(np.concatenate(values).astype(np.int64)))], names=["doc_id", "start", "ids"])


def digests(shards: DataFrame) -> DataFrame:
    """Per entry of the shards, read back: doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian 32-bit numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                reader = Reader(file)
                rows = []
                for key, value in reader:
                    ids = np.frombuffer(value, f"<u{reader.width}").astype("<u4")
                    rows.append((id_of(key), start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                    if len(rows) >= 10_000:
                        yield _digest_batch(rows)
                        rows = []
                if rows:
                    yield _digest_batch(rows)

    return shards.select("file", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def lookup(shards: DataFrame, wanted: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id and ids of the wanted identifiers: each shard gets those in its key range, and answers them by its filter,
    index and one block each. Identifiers that no shard holds have no row.

    The ranges, one per shard, are a driver-side list that each task searches; identifiers are spread by shard.
    """
    spark = shards.sparkSession
    ranges = sorted((bytes(r.first_key), bytes(r.last_key), r.file) for r in shards.select("first_key", "last_key", "file").collect())
    sent = spark.sparkContext.broadcast(ranges)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [x[1] for x in sent.value]
        for b in batches:
            docs, files = [], []
            for d in b.column(0).to_pylist():
                key = key_of(d)
                i = bisect_left(last, key)
                while i < len(last) and sent.value[i][0] <= key:
                    docs.append(d)
                    files.append(sent.value[i][2])
                    i += 1
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(files, pa.string())], names=["doc_id", "file"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for b in batches:
            docs, values = [], []
            for d, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if file != name:
                    name, reader = file, Reader(file)
                for v in reader.lookup(key_of(d)):
                    docs.append(d)
                    values.append(np.frombuffer(v, f"<u{reader.width}").astype(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(values, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    routed = wanted.select(F.col(doc_id).cast("long").alias("doc_id")).distinct().mapInArrow(route, "doc_id long, file string")
    return routed.repartition("file").sortWithinPartitions("file", "doc_id").mapInArrow(answer, "doc_id long, ids array<long>")
