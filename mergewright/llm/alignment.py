"""Alignment of two tokenizers' tokens over the same bytes.

Every text, with a space before it, is encoded by a byte-level BPE (A) and by a sentencepiece model (B, which adds the
space). Inside a task all steps work on Arrow columns of a batch of documents: the lists of ids are flattened and told
their documents (parent indices), the bytes of tokens are summed per document to end offsets, and an Acero hash join on
(document, end) finds the places where tokens of both end, which cut the tokens into groups. Each stretch between two
neighbouring ends of either side is one link: the pair of tokens that overlap there.

The encoded documents are stored once, with a list of their different linked pairs of ids. Partial counts of pairs come
from Table.group_by over that table, and Spark sums them; the highest count of each B id is joined back. The most frequent
pairs, HEAD_PAIRS at most, travel to the tasks that add up each document's links; what a document has of other pairs is
shuffled to a join with their counts. So every link meets its count, and nothing that grows with the corpus is broadcast.

Cases: texts that are null or empty, or whose bytes either tokenizer doesn't give back, have no tokens (zeros, '');
strings of special tokens are plain text; texts are encoded whole; repeated rows count again and have rows of their own;
an empty table gives an empty table. Only the key columns named are carried, and one that clashes with results is refused.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, common

#: Pairs whose counts are broadcast at most (17 bytes each).
HEAD_PAIRS = 1_000_000
#: Bytes of texts that are aligned together.
BATCH_BYTES = 1 << 20
#: Pieces of text that a worker remembers with their ids; of more than KEPT_CHARS characters none.
KEPT, KEPT_CHARS = 400_000, 48
#: Rows of partial counts that a task holds before it passes them on.
HELD = 1_000_000
#: A place in a batch is document * SPAN + byte.
SPAN = 1 << 40
SPACE = "▁"
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")


class Pieces:
    """Ids of a sentencepiece model, which adds the space before a text.

    Where no piece of the model holds a space after another character, and the model leaves characters as they are, its
    merges never cross the place between a non-space and a space: texts are cut there, and a part met before is looked up.
    Other models encode whole texts.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(len(self.model))]
        self.table = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        probe = "a  Bé é ﬁ ¼　Ａ Ω"
        self.parted = all(SPACE not in p.lstrip(SPACE) for p in pieces) and self.model.decode(self.model.encode(probe)) == probe
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", x).tobytes() for x in self.model.encode(texts, num_threads=1)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.parted:
            return self._encode(texts)
        # A part is what follows its first space: "x" of " x", " x" of "  x".
        cut = [t.split(" ") if not RUNS.search(t) else [p[1:] for p in PART.findall(" " + t)] for t in texts]
        if len(self.known) > KEPT:
            self.known.clear()
        known = self.known
        fresh = sorted(set().union(*cut).difference(known)) if cut else []
        known.update(zip(fresh, self._encode(fresh), strict=True))
        # The model has no ids for an empty text, which here is a space of its own.
        if "" in known and not known[""]:
            known[""] = array("I", [self.model.piece_to_id(SPACE)]).tobytes()
        out = [b"".join(map(known.__getitem__, c)) if t else b"" for c, t in zip(cut, texts, strict=True)]
        for p in fresh:
            if len(p) > KEPT_CHARS:
                del known[p]
        return out


#: A space before another one, at the beginning or at the end.
RUNS = re.compile(r"^ |  | $")
#: Spaces and what follows them.
PART = re.compile(r" +[^ ]*")


class Tools:
    def __init__(self, byte_model: str, piece_model: bytes):
        self.a, self.b = bpe.PieceEncoder(byte_model, kept=bpe.KEPT), Pieces(piece_model)
        self.a.added, self.a.tokenizer.encode_special_tokens = [], True
        self.bytes = [pa.array(t, pa.large_binary()) for t in (bpe.token_table(byte_model), self.b.table)]
        self.lengths = [pc.cast(pc.binary_length(t), pa.int64()) for t in self.bytes]
        self.decimal = [pa.array(list(map(str, range(len(t)))), pa.large_string()) for t in self.bytes]


class Side:
    """The tokens of one tokenizer over a batch: flat ids, their documents, and the places where they end."""

    def __init__(self, encoded: list[bytes], lengths: pa.Array):
        counts = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        flat = np.frombuffer(b"".join(encoded), np.uint32).astype(np.int64)
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)])), pa.array(flat))
        self.counts, self.ids, self.doc = counts, pc.list_flatten(lists), pc.list_parent_indices(lists)
        size = pc.take(lengths, self.ids)
        # Sums over the whole batch, less what stood before the token's document: sums of each document's own.
        run = pc.cumulative_sum(size)
        total = np.concatenate([[0], run.to_numpy()])
        first = total[np.concatenate([[0], np.cumsum(counts)])]
        self.end = pc.subtract(run, pc.take(pa.array(first[:-1]), self.doc))
        self.bytes_from = first

    def places(self) -> pa.Array:
        return pc.add(pc.multiply(pc.cast(self.doc, pa.int64()), SPAN), self.end)


def _same(sides: list[Side], tools: Tools, texts: list[str]) -> list[bool]:
    """Whether the bytes of both sides' tokens are the text's with a space before it."""
    spelled = []
    for side, table in zip(sides, tools.bytes, strict=True):
        data = pc.take(table, side.ids).buffers()[2]
        spelled.append(memoryview(data).cast("B") if data else memoryview(b""))
    out = []
    for i, t in enumerate(texts):
        want = b" " + t.encode() if t else b""
        out.append(bool(t) and all(m[s.bytes_from[i] : s.bytes_from[i + 1]] == want for m, s in zip(spelled, sides, strict=True)))
    return out


def _joined(strings: pa.Array, ends: np.ndarray, mark: str) -> pa.Array:
    """Strings joined by a mark, each list of them ending at a place of `ends`."""
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends])), strings)
    return pc.binary_join(lists, pa.scalar(mark, pa.large_string()))


def align(texts: list[str], tools: Tools) -> dict[str, pa.Array]:
    """Counts, digest of groups, and different linked pairs (A id * size of B + B id) with their numbers, of each text."""
    encoded = [tools.a([" " + t if t else "" for t in texts]), tools.b(texts)]
    sides = [Side(e, n) for e, n in zip(encoded, tools.lengths, strict=True)]
    same = _same(sides, tools, texts)
    if not all(same):
        sides = [Side([x if ok else b"" for x, ok in zip(e, same, strict=True)], n) for e, n in zip(encoded, tools.lengths, strict=True)]
    a, b = sides
    places = [s.places() for s in sides]
    # Where tokens of both end: a hash join on the place.
    left, right = (pa.table({"place": p, name: pa.array(np.arange(len(p)))}) for p, name in zip(places, ("at_a", "at_b"), strict=True))
    met = left.join(right, "place", join_type="inner", use_threads=False).sort_by("place")
    ends = [met.column(c).to_numpy() + 1 for c in ("at_a", "at_b")]
    parts = [_joined(pc.take(d, s.ids), e, ",") for d, s, e in zip(tools.decimal, sides, ends, strict=True)]
    groups = pc.binary_join_element_wise(*parts, pa.scalar("|", pa.large_string()))
    n_groups = np.bincount(met.column("place").to_numpy() // SPAN, minlength=len(texts))
    whole = _joined(groups, np.cumsum(n_groups), ";").to_pylist()
    # Every end of either side closes a link of the tokens that hold the byte before it.
    flat = [p.to_numpy() for p in places]
    every = np.sort(np.concatenate(flat), kind="stable")
    every = every[np.concatenate([[True], every[1:] != every[:-1]])] if len(every) else every
    pair = a.ids.to_numpy()[np.searchsorted(flat[0], every)] * len(tools.decimal[1]) + b.ids.to_numpy()[np.searchsorted(flat[1], every)] if len(every) else every
    doc = every // SPAN
    order = np.lexsort((pair, doc))
    pair, doc = pair[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])])) if len(pair) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate([new, [len(pair)]]))
    at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(texts)))]).astype(np.int32))
    return {
        "n_a": pa.array(a.counts), "n_b": pa.array(b.counts), "n_groups": pa.array(n_groups), "n_links": pa.array(np.bincount(doc, minlength=len(texts))),
        "groups_sha256": pa.array([hashlib.sha256(w.encode()).hexdigest() if w else "" for w in whole], pa.string()),
        "pairs": pa.ListArray.from_arrays(at, pa.array(pair[new])), "times": pa.ListArray.from_arrays(at, pa.array(times.astype(np.int32))),
    }


def encoded(docs: DataFrame, byte_model: str, piece_model: bytes, keys: list[str], text: str = "text") -> DataFrame:
    """The key columns, __row (a number of the row), the results of each document, and its pairs and times; to be stored
    once, for a row's number is the task's and the row's place in it."""
    if clash := {*RESULTS, "n_best", "count_sum", "pairs", "times", "__row"} & set(keys):
        raise ValueError(f"key columns clash with results: {sorted(clash)}")
    whole, many = T.LongType(), lambda t: T.ArrayType(t, False)
    fields = [T.StructField(c, T.StringType() if c == "groups_sha256" else whole) for c in RESULTS]
    schema = T.StructType([*(docs.schema[k] for k in keys), T.StructField("__row", whole), *fields, T.StructField("pairs", many(whole)), T.StructField("times", many(T.IntegerType()))])
    sent, n = docs.sparkSession.sparkContext.broadcast((byte_model, piece_model)), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = bpe._worker(hash(sent.value), lambda: Tools(*sent.value))
        row = TaskContext.get().partitionId() << 40
        for b in common.sliced(batches, "__text", BATCH_BYTES):
            got = align(common.texts(b.column(n)), tools)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(np.arange(row, row + b.num_rows)), *got.values()], names=schema.names)
            row += b.num_rows

    return docs.select(*keys, F.col(text).alias("__text")).mapInArrow(run, schema)


def pair_counts(stored: DataFrame, size_b: int) -> DataFrame:
    """pair, n (its links over all documents) and best (n is the highest of the pair's B id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])

        for b in batches:
            part = pa.table({"pair": pc.list_flatten(b.column(0)), "n": pc.cast(pc.list_flatten(b.column(1)), pa.int64())})
            held.append(part)
            size += part.num_rows
            if size > HELD:
                held = [summed()]
                size = held[0].num_rows
                if size > HELD // 2:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from summed().to_batches()

    counts = stored.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = common.stored(counts.withColumn("b", F.expr(f"pair % {size_b}L")), "alignment-counts")
    # One row for each id of B's vocabulary at most.
    highest = F.broadcast(counts.groupBy("b").agg(F.max("n").alias("__highest")))
    return counts.join(highest, "b").select("pair", "n", (F.col("n") == F.col("__highest")).alias("best"))


def with_counts(stored: DataFrame, counts: DataFrame, keys: list[str], head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """The key columns and results of each document, with n_best and count_sum over its links."""
    head = common.most_frequent(counts, "n", head_pairs)
    table = head.toArrow().sort_by("pair")
    known = [table.column(c).to_numpy() for c in ("pair", "n", "best")]
    sent = stored.sparkSession.sparkContext.broadcast(known)
    rest = counts.count() > table.num_rows
    schema = T.StructType([*(stored.schema[k] for k in keys), T.StructField("__row", T.LongType()), *(stored.schema[c] for c in RESULTS), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    n = len(keys) + 1 + len(RESULTS)

    def places(known: list[np.ndarray], pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(known[0], pairs), max(len(known[0]) - 1, 0))
        return at, known[0][at] == pairs if len(known[0]) else np.zeros(len(pairs), bool)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            pairs, times = b.column(n).flatten().to_numpy(), b.column(n + 1).flatten().to_numpy().astype(np.int64)
            doc = pc.list_parent_indices(b.column(n)).to_numpy()
            at, have = places(known, pairs)
            out = np.zeros((2, b.num_rows), np.int64)
            at, times, doc = at[have], times[have], doc[have]
            np.add.at(out[0], doc, times * known[2][at])
            np.add.at(out[1], doc, times * known[1][at])
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(out[0]), pa.array(out[1])], names=schema.names)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            pairs, times = b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy()
            _, have = places(known, pairs)
            doc = b.column(0).to_numpy()[pc.list_parent_indices(b.column(1)).to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array(doc[~have]), pa.array(pairs[~have]), pa.array(times[~have])], names=["__row", "pair", "times"])

    out = stored.select(*keys, "__row", *RESULTS, "pairs", "times").mapInArrow(sums, schema)
    if rest:
        late = stored.select("__row", "pairs", "times").mapInArrow(others, "__row long, pair long, times int").join(counts, "pair")
        late = late.groupBy("__row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("__best"), F.sum(F.col("times") * F.col("n")).alias("__sum"))
        out = out.join(late, "__row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("__best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("__sum", F.lit(0))})
    return out.select(*keys, *RESULTS, "n_best", "count_sum")


def aligned(docs: DataFrame, byte_model: str, piece_model: bytes, keys: list[str], head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """The key columns and, of each document, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum."""
    import sentencepiece

    size_b = len(sentencepiece.SentencePieceProcessor(model_proto=piece_model))
    stored = common.stored(encoded(docs, byte_model, piece_model, keys), "alignment")
    return with_counts(stored, pair_counts(stored, size_b), keys, head_pairs)
