"""Quality classifier: a linear support-vector machine over n-gram indicators scaled by Naive Bayes log-count ratios.

An n-gram is there or not: single words, pairs of neighbours, and triples of word shapes (case, digits, marks, a repeat
of the word before), each hashed to one of 2**BITS features. A feature's scale is the log of its share among documents
of label 1 over its share among those of label 0, counted over every labelled training document. The weights come from
dual coordinate descent on the hinge loss over a bounded sample of those, and a logistic curve over the margins of
another part of the sample turns margins into probabilities.

Cases: a null or empty text has no features and gets the score of the intercept; texts are read whole; a repeated row
gets an equal row, and counts each time where it is labelled; a null label, or one without a document, teaches nothing;
without labels of both classes every score is the share of label 1 (0.5 without labels); an empty table gives an empty
result; only the key columns asked for are carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BITS = 18
SIZE = 1 << BITS
#: Labelled rows for the weights and the curve together; every fifth of them serves the curve.
SAMPLE = 12_000
KEPT_WORDS = 100_000
_UPPER, _LOWER, _DIGIT, _MARK, _OTHER, _REPEAT = 1, 2, 4, 8, 16, 32
_KINDS = np.array([_UPPER if 65 <= b < 91 else _LOWER if 97 <= b < 123 else _DIGIT if 48 <= b < 58 else _MARK if b < 128 else _OTHER for b in range(256)], np.uint8)


class Grams:
    """Feature numbers of texts; the words met last are kept with their hash and shape."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def _new(self, word: bytes) -> int:
        """The hash of the word in lower case, and its shape in the low six bits (never 0)."""
        got = self.known[word] = zlib.crc32(word.lower()) << 6 | int(np.bitwise_or.reduce(_KINDS[np.frombuffer(word, np.uint8)]))
        return got

    def __call__(self, text: str) -> np.ndarray:
        ws = common.words(text)
        if not ws:
            return np.zeros(0, np.int64)
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        known, new = self.known.get, self._new
        both = np.array([known(w) or new(w) for w in ws], np.uint64)
        h, s = both >> np.uint64(6), both & np.uint64(31)
        s[1:] |= np.where(h[1:] == h[:-1], np.uint64(_REPEAT), np.uint64(0))
        pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        shapes = (s[:-2] << np.uint64(12)) | (s[1:-1] << np.uint64(6)) | s[2:]
        grams = np.concatenate([h, pairs ^ np.uint64(0xA5A5A5A5), shapes + np.uint64(1 << 40), s + np.uint64(1 << 41)])
        mixed = (grams ^ (grams >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return np.unique((mixed >> np.uint64(64 - BITS)).astype(np.int64))


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -30, 30)))

    def margin(self, grams: np.ndarray) -> float:
        return float(self.weight[grams].sum()) + self.bias


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = 0.02, epochs: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights over scaled indicators, and the intercept, that minimise |w|^2 / 2 + the hinge losses (labels 1 and -1).

    One dual variable after another is set to its best value between 0 and its class's cost, in a seeded order.
    """
    w, bias = np.zeros(len(scale)), 0.0
    share = np.where(y > 0, (y < 0).sum(), (y > 0).sum()) * 2 / len(y)
    top, alpha = cost * share, np.zeros(len(y))
    xs = [scale[r] for r in rows]
    q = np.array([x @ x + 1 for x in xs])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            r, x = rows[i], xs[i]
            slope = y[i] * (w[r] @ x + bias) - 1
            new = min(max(alpha[i] - slope / q[i], 0.0), top[i])
            if (step := (new - alpha[i]) * y[i]) != 0:
                w[r] += step * x
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-5:
            break
    return w, bias


def logistic_curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(label 1 | margin), by Newton steps on smoothed targets."""
    positive, negative = (y > 0).sum(), (y <= 0).sum()
    goal = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((goal - p) * margins).sum(), (goal - p).sum()])
        v = p * (1 - p) + 1e-9
        hess = np.array([[(v * margins**2).sum(), (v * margins).sum()], [(v * margins).sum(), v.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, g)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-6:
            break
    return a, b


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, alpha: float = 1.0) -> Model:
    rows = common.labelled(docs, labels)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, grams = np.zeros((2, SIZE), np.int64), np.zeros(2, np.int64), Grams()
        for b in common.sliced(batches):
            for y, text in zip(b.column(1).to_pylist(), common.texts(b.column(2)), strict=True):
                sums[int(y > 0), grams(text)] += 1
                n[int(y > 0)] += 1
        at = np.flatnonzero(sums.sum(0))
        if n.sum():  # feature -1 counts documents
            cut = 1 << 15
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array(n[:1]), pa.array(n[1:])], names=["feature", "n0", "n1"])
            for i in range(0, len(at), cut):
                a = at[i : i + cut]
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(sums[0, a]), pa.array(sums[1, a])], names=["feature", "n0", "n1"])

    counted = rows.mapInArrow(count, "feature int, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    feature, n0, n1 = (counted.column(c).to_numpy() for c in ("feature", "n0", "n1"))
    sums = np.zeros((2, SIZE))
    real = feature >= 0
    sums[0, feature[real]], sums[1, feature[real]] = n0[real], n1[real]
    docs0, docs1 = int(n0[~real].sum()), int(n1[~real].sum())
    if not docs0 or not docs1:
        share = (docs1 + 1) / (docs0 + docs1 + 2)
        return Model(np.zeros(SIZE), 0.0, 1.0, float(np.log(share / (1 - share))))
    ratio = np.log((sums[1] + alpha) / (sums[1] + alpha).sum()) - np.log((sums[0] + alpha) / (sums[0] + alpha).sum())
    ratio[sums.sum(0) == 0] = 0

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for b in common.sliced(batches):
            found = [grams(t).astype(np.int32).tobytes() for t in common.texts(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], names=["doc_id", "y", "grams"])

    some = common.labelled_sample(docs, labels, sample).select("doc_id", "__y", "text").mapInArrow(grams_of, "doc_id long, y int, grams binary").toArrow()
    table = sorted(zip(some.column("doc_id").to_pylist(), some.column("y").to_pylist(), some.column("grams").to_pylist(), strict=True))
    found = [np.frombuffer(g, np.int32) for _, _, g in table]
    y = np.array([1 if v > 0 else -1 for _, v, _ in table])
    late = np.array([zlib.crc32(b"curve:%d" % d) % 5 == 0 for d, _, _ in table], bool)
    if len(set(y[~late])) < 2 or len(set(y[late])) < 2:
        late = np.zeros(len(y), bool)
    w, bias = dual_descent([r for r, z in zip(found, late, strict=True) if not z], y[~late], ratio)
    weight = w * ratio
    test = late if late.any() else ~late
    margins = np.array([weight[r].sum() + bias for r, z in zip(found, test, strict=True) if z])
    return Model(weight, bias, *logistic_curve(margins, y[test]))


def score(docs: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """The key columns, margin, score (probability of label 1) and predicted of each document."""
    if clash := {"margin", "score", "predicted"} & set(keys):
        raise ValueError(f"key columns clash with results: {sorted(clash)}")
    schema = T.StructType([*(docs.schema[k] for k in keys), T.StructField("margin", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, grams = sent.value, Grams()
        for b in common.sliced(batches, "__text"):
            margins = np.array([model.margin(grams(t)) for t in common.texts(b.column(n))])
            p = model.probability(margins)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(margins, pa.float64()), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=schema.names)

    return docs.select(*keys, F.col("text").alias("__text")).mapInArrow(run, schema)
