"""Toxicity by class-conditional Kneser-Ney models.

Words are lower-cased (A-Z), cut at white space and stripped of ASCII marks. A vocabulary of words and of their beginnings
(PREFIX code points) that come MIN_COUNT times in the labelled training texts closes the language: a word outside it
stands for its beginning, and where that isn't known either for one unknown word. Each class (toxic, ordinary) has the
Kneser-Ney distribution of its words: the number of different words that stand before a word in texts of the class,
discounted absolutely. What the discount frees goes to a distribution that both classes share: the same numbers over both
together, discounted to a uniform one. So an expression that is rare in both classes has nearly the same probability in
both and says nothing.

The two log-likelihoods of a text, a word each on average, are compared in four ways: over the whole text; at the word
that speaks most for toxicity, and at the two that do; and as the mean of the words' likelihood ratios, in which a few
strong ones in a long text still count. A logistic curve over these turns them into a score; it is fitted on rows that the models aren't.
A conditional level above (counts of word pairs) was measured and left out: it told held-out texts apart worse, for the
ordinary class, with nine times the text, knows more pairs of any text.

All labelled rows are counted. The bounds are of the model alone: WORDS entries (the most frequent ones), CURVE_ROWS rows
for the curve.

Cases: a text without words, empty or null has the score of likelihoods that are equal; texts are read whole; a repeated
row gets an equal row, and counts again where it is labelled; a null label or id, or a label without a document, teaches
nothing; without labels of both classes every score is the share of toxic labels (0.5 without labels); an empty table
gives an empty result; only the key columns asked for are carried.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MIN_COUNT, PREFIX = 3, 5
#: Entries of the vocabulary at most: 16 bytes each, broadcast.
WORDS = 1_000_000
#: Rows for the curve at most (of every fifth labelled training row).
CURVE_ROWS = 20_000
#: Different words that a worker remembers, and pairs that a task holds before it passes them on.
KEPT, HELD = 200_000, 1_000_000
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: A word's log ratio counts up to this in the mean of ratios.
HIGHEST = 20.0
FEATURES = ("whole", "strongest", "two_strongest", "mean_ratio")


def keys_of(word: bytes) -> tuple[int, int] | None:
    """Hashes of a lower-cased word and of its beginning (0 where it is shorter); None for marks alone."""
    w = word.strip(MARKS)
    if not w:
        return None
    start = w.decode(errors="replace")[:PREFIX]
    return xxhash.xxh64_intdigest(w), xxhash.xxh64_intdigest(b"~" + start.encode()) if len(start) == PREFIX else 0


class Reader:
    """Entry numbers of texts' words: places in the sorted keys of a vocabulary, len(keys) for the unknown word."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.unknown = keys, len(keys)
        self.known: dict[bytes, int] = {}

    def _entry(self, word: bytes) -> int:
        got = -1
        if (both := keys_of(word)) is not None:
            got = self.unknown
            for k in both:
                at = int(np.searchsorted(self.keys, np.uint64(k)))
                if k and at < len(self.keys) and int(self.keys[at]) == k:
                    got = at
                    break
        self.known[word] = got
        return got

    def __call__(self, text: str) -> np.ndarray:
        ws = common.lower_words(text)
        if len(self.known) > KEPT:
            self.known.clear()
        get = self.known.get
        found = np.array([self._entry(w) if (e := get(w)) is None else e for w in ws], np.int64)
        return found[found >= 0]


@dataclass
class Model:
    keys: np.ndarray
    #: Natural logs of each entry's probability, and of the unknown word's at the end.
    toxic: np.ndarray
    ordinary: np.ndarray
    weight: np.ndarray
    bias: float

    def features(self, entries: np.ndarray) -> tuple[float, ...]:
        """Mean log-likelihoods of both classes, and the four comparisons."""
        if not len(entries):
            return (0.0,) * (2 + len(FEATURES))
        t, o = self.toxic[entries].astype(float), self.ordinary[entries].astype(float)
        ratio = t - o
        return t.mean(), o.mean(), ratio.mean(), ratio.max(), np.partition(ratio, -2)[-2:].mean() if len(ratio) > 1 else ratio[0] / 2, float(np.log(np.exp(np.minimum(ratio, HIGHEST)).mean()))

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weight + self.bias, -30, 30)))


def discount(counts: np.ndarray) -> float:
    """Absolute discount from the numbers of ones and twos."""
    ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
    return ones / (ones + 2 * twos) if ones and twos else 0.5


def kneser_ney(contexts: np.ndarray) -> np.ndarray:
    """Log probabilities [2, entries] from numbers of contexts [2, entries]: each class over what both share."""
    both = contexts.sum(0)
    d = discount(both)
    shared = (np.maximum(both - d, 0) + d * (both > 0).sum() / len(both)) / both.sum()
    out = np.empty(contexts.shape)
    for p, n in zip(out, contexts, strict=True):
        d = discount(n)
        p[:] = np.log((np.maximum(n - d, 0) + d * (n > 0).sum() * shared) / n.sum())
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression with a ridge on standardised features, by Newton steps."""
    mean, sd = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / sd, float(w[-1] - (w[:-1] / sd * mean).sum())


def training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """__y, __curve (the row is for the curve) and text of labelled rows outside the held-out fifth (crc32 of the id mod 5 is 0)."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(F.pmod(common.id_crc(), F.lit(5)) != 0)
    curve = F.pmod(F.crc32(F.concat(F.lit("curve:"), F.col("doc_id").cast("string"))), F.lit(5)) == 0
    known = known.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("__y"), curve.alias("__curve"))
    if known.count() <= common.BROADCAST_LABELS:
        known = F.broadcast(known)
    return docs.select("doc_id", F.col("text")).join(known, F.col("doc_id") == F.col("__id")).select("__y", "__curve", "text")


def _word_counts(rows: DataFrame) -> DataFrame:
    """key (hash of a word or beginning) and n over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            sums: dict[int, int] = defaultdict(int)
            for w, n in held.items():
                for k in keys_of(w) or ():
                    sums[k] += n
            sums.pop(0, None)
            held.clear()
            keys = np.fromiter(sums.keys(), np.uint64, len(sums))
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(list(sums.values()), pa.int64())], names=["key", "n"])

        for b in common.sliced(batches):
            for text in common.texts(b.column(0)):
                held.update(common.lower_words(text))
                if len(held) > KEPT:
                    yield flush()
        yield flush()

    return rows.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _contexts(rows: DataFrame, keys: np.ndarray) -> np.ndarray:
    """For both classes the number of different entries (or a text's beginning) that stand before each entry."""
    sent, n = rows.sparkSession.sparkContext.broadcast(keys), len(keys)
    base = n + 2  # the unknown word is n, a text's beginning n + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held, size = Reader(sent.value), [], 0
        for b in common.sliced(batches):
            for y, text in zip(b.column(0).to_pylist(), common.texts(b.column(1)), strict=True):
                e = reader(text)
                if len(e):
                    held.append((np.concatenate([[base - 1], e[:-1]]) * base + e) * 2 + int(y > 0))
                    size += len(e)
                if size > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)))], names=["pair"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)))], names=["pair"])

    pairs = rows.select("__y", "text").mapInArrow(run, "pair long").distinct()
    entry = F.expr(f"shiftright(pair, 1) % {base}L")
    sums = pairs.groupBy(entry.alias("entry"), F.expr("pair & 1L").alias("y")).count().toArrow()
    out = np.zeros((2, n + 1))
    out[sums.column("y").to_numpy(), sums.column("entry").to_numpy()] = sums.column("count").to_numpy()
    return out


def learn(docs: DataFrame, labels: DataFrame, words: int = WORDS, curve_rows: int = CURVE_ROWS) -> Model:
    rows = common.stored(training(docs, labels), "toxicity-rows")
    fit, curve = rows.where("NOT __curve"), rows.where("__curve")
    have = {bool(r["toxic"]): r["count"] for r in rows.groupBy((F.col("__y") > 0).alias("toxic")).count().collect()}
    share = (have.get(True, 0) + 1) / (sum(have.values()) + 2) if len(have) < 2 else 0.5
    flat = Model(np.zeros(0, np.uint64), np.zeros(1, np.float32), np.zeros(1, np.float32), np.zeros(len(FEATURES)), float(np.log(share / (1 - share))))
    if len(have) < 2:
        common.discard(rows)
        return flat
    counts = common.stored(_word_counts(fit).where(F.col("n") >= MIN_COUNT), "toxicity-words")
    keys = np.sort(common.most_frequent(counts, "n", words).select("key").toArrow().column("key").to_numpy().view(np.uint64))
    contexts = _contexts(fit, keys)
    if not contexts.sum(1).all():
        # All rows of one class are for the curve.
        contexts = _contexts(rows, keys)
    if not contexts.sum(1).all():
        # One class's texts have no words at all.
        return flat
    log = kneser_ney(contexts).astype(np.float32)
    model = Model(keys, log[1], log[0], np.zeros(len(FEATURES)), 0.0)

    def compared(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        some = common.hash_sample(df.select("__y", "text"), "text", curve_rows)
        got = _compared(some, model, ["__y"]).select("__y", *FEATURES).orderBy("__y", *FEATURES).toArrow()
        return np.column_stack([got.column(f).to_numpy() for f in FEATURES]), (got.column("__y").to_numpy() > 0).astype(float)

    x, y = compared(curve)
    if not 0 < y.sum() < len(y):
        x, y = compared(rows)
    model.weight, model.bias = logistic(x, y)
    common.discard(counts)
    common.discard(rows)
    return model


def _compared(docs: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    names = ("toxic_ll", "ordinary_ll", *FEATURES, "score")
    schema = T.StructType([*(docs.schema[k] for k in keys), *(T.StructField(c, T.DoubleType()) for c in names)])
    sent, n = docs.sparkSession.sparkContext.broadcast(model), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        reader = Reader(model.keys)
        for b in common.sliced(batches, "__text"):
            values = np.array([model.features(reader(t)) for t in common.texts(b.column(n))]).reshape(-1, 2 + len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *(pa.array(v) for v in values.T), pa.array(model.probability(values[:, 2:]))], names=schema.names)

    return docs.select(*keys, F.col("text").alias("__text")).mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """The key columns, both mean log-likelihoods (natural logs, a word), score (probability of toxic) and predicted."""
    if clash := {"toxic_ll", "ordinary_ll", *FEATURES, "score", "predicted"} & set(keys):
        raise ValueError(f"key columns clash with results: {sorted(clash)}")
    return _compared(docs, model, keys).select(*keys, "toxic_ll", "ordinary_ll", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
