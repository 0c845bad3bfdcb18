"""Spelling variants: words one edit apart, each led to the far more frequent word next to it.

Words are counted over all texts. The vocabulary's words lie in Bloom filters, one shard for each length, whose blocks are
64-bit numbers; their size is bounded by FILTER_BITS, so they are broadcast whatever the vocabulary is. Every word's edits
are generated as changes of a polynomial hash (a deletion drops a term and shifts those behind it, a replacement changes
one term) and probed against the shard of their length. Only hits are shuffled, as two hashes each, to a join with the
vocabulary, where false ones find nothing or fail the exact comparison. An insertion is the deletion of the longer word,
and a replacement is probed from the word with the smaller letter, so each pair is found from one of its two words.

Cases: a null or empty text has no words; a null doc_id counts as an empty text in the hash of a run; a repeated row
counts again; words of any length are probed at all their places; of near words of equal count the one that sorts first
is the form; an empty table gives an empty table. Only doc_id and text are read, so further columns can't clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A word has so many code points and occurrences at least.
LETTERS, OCCURRENCES = 6, 5
#: A near word is a form from so many times the word's own count.
TIMES = 5
#: One run in so many, by crc32, loses a letter.
DAMAGED = 199
#: Letters of words after A-Z are lower-cased: a replacement puts one of these.
ALPHABET = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint32)
RUN = re.compile("[a-zÀ-ÿ]+")
#: All filters together have so many bits at most (32 MB); with more words than that holds, hits that are false become more.
FILTER_BITS = 1 << 28
BITS_PER_WORD, BITS_SET = 32, 5
#: Words of so many code points and more share a shard.
LONGEST = 64
#: Different words that a task holds before it passes its counts on.
HELD = 200_000
#: Letters of words that are probed together.
PROBED = 200_000

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_RANDOM = np.random.default_rng(13).integers(1 << 63, size=0x100, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def counted(docs: DataFrame) -> DataFrame:
    """word and n: the damaged runs of all texts of at least LETTERS code points, and how often they come (all of them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = defaultdict(int)

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in common.sliced(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), common.texts(b.column(1)), strict=True):
                start = zlib.crc32(b"%s:" % ("" if doc_id is None else str(doc_id)).encode())
                for w, n in Counter(RUN.findall(text.encode().lower().decode())).items():
                    if len(w) < LETTERS:
                        continue
                    if (h := zlib.crc32(w.encode(), start)) % DAMAGED == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                    if len(w) >= LETTERS:
                        held[w] += n
                if len(held) > HELD:
                    yield flush()
        yield flush()

    parts = docs.select("doc_id", F.col("text")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def _powers(length: int) -> np.ndarray:
    out = np.full(length, _PRIME, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _terms(codes: np.ndarray) -> np.ndarray:
    return _RANDOM[codes] * _powers(codes.shape[1])


def by_length(words: list[str]) -> dict[int, np.ndarray]:
    """Places of the words of each length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}


def hashes(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    for length, at in by_length(words).items():
        out[at] = _terms(_codes([words[i] for i in at], length)).sum(1, dtype=np.uint64)
    return out


class Filters:
    """Blocked Bloom filters, one range of 64-bit blocks for each length of words."""

    def __init__(self, counts: dict[int, int], bits: int = FILTER_BITS):
        per_word = min(BITS_PER_WORD, bits / max(1, sum(counts.values())))
        self.size, self.start, at = {}, {}, 0
        for length, n in sorted(counts.items()):
            self.size[length], self.start[length] = max(1, int(n * per_word) >> 6), at
            at += self.size[length]
        self.blocks = np.zeros(at, np.uint64)

    def place(self, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The block of each hash in its length's shard, and the bits that it sets there."""
        shard = min(length, LONGEST)
        x = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        block = (((x >> np.uint64(32)) * np.uint64(self.size[shard])) >> np.uint64(32)).astype(np.int64) + self.start[shard]
        y = x * np.uint64(0xFF51AFD7ED558CCD)
        bits = reduce(np.bitwise_or, (np.uint64(1) << ((y >> np.uint64(58 - 6 * i)) & np.uint64(63)) for i in range(BITS_SET)))
        return block, bits

    def hit(self, h: np.ndarray, length: int) -> np.ndarray:
        if min(length, LONGEST) not in self.size:
            return np.zeros(h.shape, bool)
        block, bits = self.place(h, length)
        return (self.blocks[block] & bits) == bits


def probe(words: list[str], filters: Filters) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and of those of their edits that a filter knows: all deletions, and replacements by a later letter."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    letters = _RANDOM[ALPHABET]
    for length, at in by_length(words).items():
        codes = _codes([words[i] for i in at], length)
        power, terms = _powers(length), _terms(codes)
        whole = terms.sum(1, dtype=np.uint64)
        before, behind = np.zeros(len(at), np.uint64), whole.copy()
        # What stands behind a deleted letter moves down one place: its terms lose one factor of the prime, so they are summed anew.
        shifted = np.zeros(len(at), np.uint64)
        if length > LETTERS:
            shifted = (_RANDOM[codes[:, 1:]] * power[:-1]).sum(1, dtype=np.uint64)
        for i in range(length):
            behind -= terms[:, i]
            other = behind[:, None] + before[:, None] + letters * power[i]
            hit = (codes[:, i, None] < ALPHABET) & filters.hit(other, length)
            if hit.any():
                found.append((whole[hit.nonzero()[0]], other[hit]))
            if length > LETTERS:
                gone = before + shifted
                hit = filters.hit(gone, length - 1)
                found.append((whole[hit], gone[hit]))
                if i + 1 < length:
                    shifted -= _RANDOM[codes[:, i + 1]] * power[i]
            before += terms[:, i]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _hashed(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(hashes(b.column(0).to_pylist()).view(np.int64)), *b.columns], names=["hash", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "hash long, word string, n long")


def build_filters(vocabulary: DataFrame, bits: int = FILTER_BITS) -> Filters:
    """Filters over a vocabulary (hash, word, n): blocks are set in tasks, joined by bit_or, and at most `bits` of them come
    to the driver."""
    length = F.least(F.length("word"), F.lit(LONGEST))
    filters = Filters({r["length"]: r["count"] for r in vocabulary.groupBy(length.alias("length")).count().collect()}, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, lengths = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            for n in np.unique(lengths):
                block, mask = filters.place(h[lengths == n], int(n))
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(mask.view(np.int64))], names=["block", "bits"])

    if len(filters.blocks):
        empty, filters.blocks = filters.blocks, None
        set_ = vocabulary.select("hash", length.cast("long").alias("length")).mapInArrow(run, "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
        filters.blocks = empty
        filters.blocks[set_.column("block").to_numpy()] = set_.column("bits").to_numpy().view(np.uint64)
    return filters


def near_pairs(vocabulary: DataFrame, filters: Filters) -> DataFrame:
    """word, n, near and near_n of all words exactly one edit apart, in both directions."""
    sent = vocabulary.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            a, b = probe(held, sent.value)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["one", "other"])

        for b in batches:
            for w in b.column(0).to_pylist():
                held.append(w)
                size += len(w)
                if size > PROBED:
                    yield flush()
                    size = 0
        yield flush()

    hits = vocabulary.select("word").mapInArrow(run, "one long, other long")
    near = vocabulary.select(F.col("hash").alias("other"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    own = vocabulary.select(F.col("hash").alias("one"), "word", "n")
    pairs = hits.join(near, "other").join(own, "one").where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n").distinct()
    back = pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.unionByName(back)


def roots(forms: DataFrame) -> DataFrame:
    """word and root of forms (word, form): forms followed to their end. Each round doubles the steps taken, and a form is
    TIMES as frequent as its word, so a few rounds suffice."""
    at = common.stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "variant-roots")
    while at.where("open").limit(1).count():
        on = at.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        step = at.join(on, "root", "left")
        new = common.stored(step.select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("open")), "variant-roots")
        common.discard(at)
        at = new
    return at.drop("open")


def group_variants(docs: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of the vocabulary."""
    words = counted(docs).where((F.col("n") >= OCCURRENCES) & (F.length("word") >= LETTERS))
    vocabulary = common.stored(_hashed(words), "variant-words")
    near = near_pairs(vocabulary, build_filters(vocabulary, bits))
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best"))
    joined = vocabulary.select("word", "n").join(best, "word", "left")
    is_form = -F.col("best.m") >= TIMES * F.col("n")
    led = common.stored(joined.select("word", F.when(is_form, F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("best.m")).alias("form_n")), "variant-forms")
    ends = roots(led.where("form IS NOT NULL"))
    return led.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
