"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics.

Statistics are counted over whole texts, document by document. The trees (logistic loss, histogram splits, Newton leaf
values) are fitted on a bounded sample of labelled documents and flattened into numpy node arrays, by which batches are
scored without a loop over documents. Features named in MONOTONE may only lower the score as they rise: a split that
would do otherwise is not taken, and the bounds that such a split sets hold for the whole subtree.

Cases: a null or empty text has no words, so the base rules reject it; ties between splits go to the first feature and
lowest threshold; repeated rows get equal rows; a null label or label without a document is not learned from; with no
labels, or labels of one class, the trees keep everything; an empty table gives an empty result; only the key columns
asked for are carried, and one that clashes with a result is refused.
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

SYMBOLS = "#*$%&|<>"
SEPARATORS = " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "punct_share", "digit_share", "longest_word", "words_per_line"]
#: -1: a higher value may only lower the score.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1}
#: Labelled rows at most that the trees are fitted on (four in five) and the cut is placed by (the fifth).
SAMPLE = 20_000
#: How many times the share of label-1 rows that the trees reject weighs that of label-0 rows which they reject.
COST = 20.0


def repeat_words(ws: list[bytes]) -> tuple[int, int]:
    """Words that lie in a three-word window found twice or more, and the number of distinct words."""
    number: dict[bytes, int] = {}
    a = np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int64, len(ws))
    n, v = len(a), len(number)
    if n < 4:
        return 0, v
    if v < 2_000_000:
        key = (a[:-2] * v + a[1:-1]) * v + a[2:]
    else:  # three numbers don't fit 63 bits: number the pairs first
        pair = np.unique(a[:-1] * v + a[1:], return_inverse=True)[1].astype(np.int64)
        key = pair[:-1] * v + a[2:]
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    again = count[back] > 1
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= again
    return int(covered.sum()), v


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The counts and features of one text."""
    ws = common.words(text)
    n = len(ws)
    chars = len(text) - sum(map(text.count, SEPARATORS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SEPARATORS)]
    dup = len(lines) - len(set(lines))
    repeated, distinct = repeat_words(ws)
    raw = np.frombuffer(text.encode(), np.uint8)
    kinds = np.bincount(raw, minlength=256)
    upper = int(kinds[65:91].sum())
    digits = int(kinds[48:58].sum())
    punct = int(kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum())
    share = lambda a, b: a / b if b else 0.0
    features = [float(np.log1p(n)), share(chars, n), share(symbols, n), share(dup, len(lines)), share(repeated, n), share(distinct, n), share(upper, chars), share(punct, chars), share(digits, chars), float(max(map(len, ws), default=0)), share(n, len(lines))]
    return [n, chars, symbols, dup, repeated], features


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


@dataclass
class Trees:
    """Flat nodes: a leaf points to itself, so `depth` steps end at a leaf from every root. cut: lowest score that is kept."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float
    cut: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), 0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            go = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(go, self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.bias + self.value[at].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Trees:
    """Boosted trees for labels y (0 or 1) over features x, with the cut at 0.5."""
    none = np.zeros(0, np.int64)
    if len(y) == 0 or y.min() == y.max():
        return Trees(none, none.astype(float), none, none, none.astype(float), none, 0, 0.0, -1.0)
    signs = [MONOTONE.get(f, 0) for f in FEATURES]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    bias = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), bias)
    nodes: list[list] = []
    roots = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, 0.0, len(nodes), len(nodes), 0.0])
        work = [(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
        while work:
            node, rows, level, low, high = work.pop()
            total_g, total_h = g[rows].sum(), h[rows].sum()
            nodes[node][4] = rate * float(np.clip(total_g / (total_h + ridge), low, high))
            split = _best_split(binned[rows], g[rows], h[rows], edges, signs, least, ridge, low, high) if level < depth else None
            if split is None:
                margin[rows] += nodes[node][4]
                continue
            j, b, left_value, right_value = split
            go = binned[rows, j] <= b
            middle = (left_value + right_value) / 2
            bounds = {0: ((low, high), (low, high)), -1: ((middle, high), (low, middle)), 1: ((low, middle), (middle, high))}[signs[j]]
            nodes[node][:4] = [j, float(edges[j][b]), len(nodes), len(nodes) + 1]
            for side, (lo, hi) in zip((rows[go], rows[~go]), bounds, strict=True):
                work.append((len(nodes), side, level + 1, lo, hi))
                nodes.append([0, 0.0, len(nodes), len(nodes), 0.0])
    f, t, left, right, v = map(np.array, zip(*nodes, strict=True))
    inner = left != np.arange(len(left))
    return Trees(f, t, left, right, np.where(inner, 0.0, v), np.array(roots), depth, bias, 0.5)


def _best_split(binned, g, h, edges, signs, least, ridge, low, high):
    best, found = 1e-6, None
    total_g, total_h, n = g.sum(), h.sum(), len(g)
    for j, e in enumerate(edges):
        if not len(e):
            continue
        size = len(e) + 1
        sums = [np.cumsum(np.bincount(binned[:, j], w, size))[:-1] for w in (g, h, None)]
        left_g, left_h, left_n = sums
        a = np.clip(left_g / (left_h + ridge), low, high)
        b = np.clip((total_g - left_g) / (total_h - left_h + ridge), low, high)
        own = np.clip(total_g / (total_h + ridge), low, high)
        worth = lambda v, s_g, s_h: s_g * v - 0.5 * (s_h + ridge) * v * v
        gain = worth(a, left_g, left_h) + worth(b, total_g - left_g, total_h - left_h) - worth(own, total_g, total_h)
        ok = (left_n >= least) & (n - left_n >= least) & (signs[j] * (b - a) >= 0)
        gain = np.where(ok, gain, -np.inf)
        k = int(gain.argmax())
        if gain[k] > best:
            best, found = gain[k], (j, k, float(a[k]), float(b[k]))
    return found


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees fitted on at most `sample` labelled rows (common.labelled_sample), of which every fifth id only places the cut;
    one id in three (crc32 mod 3 is 1) is left out, to measure on."""
    got = _counted(common.labelled_sample(docs, labels, sample), ["doc_id", "__y"], None).select("doc_id", "__y", "features", "base_failed").toArrow()
    y = got.column("__y").to_numpy().astype(float)
    x = got.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), len(FEATURES)) if len(y) else np.zeros((0, len(FEATURES)))
    late = np.array([zlib.crc32(b"cut:%d" % d) % 5 == 0 for d in got.column("doc_id").to_pylist()], bool)
    order = np.lexsort((*x.T, y))
    x, y, late, failed = x[order], y[order], late[order], got.column("base_failed").to_numpy()[order]
    trees = fit(x[~late], y[~late])
    # What the base rules reject is no matter of the cut.
    apart = late & ~failed
    trees.cut = best_cut(trees.scores(x[apart]), y[apart]) if len(trees.roots) else -1.0
    return trees


def best_cut(scores: np.ndarray, y: np.ndarray, cost: float = COST) -> float:
    """The lowest score that is kept, 0.5 at most: where the share of label-0 rows below exceeds `cost` times the share of
    label-1 rows below by most (the lowest such score). Without rows of both labels nothing is rejected."""
    if not 0 < y.sum() < len(y):
        return -1.0
    at = np.append(np.unique(scores[scores < 0.5]), 0.5)
    bad, good = (np.searchsorted(np.sort(scores[y == v]), at, "left") / (y == v).sum() for v in (0, 1))
    return float(at[np.argmax(bad - cost * good)])


def score(docs: DataFrame, trees: Trees, keys: list[str]) -> DataFrame:
    """The key columns, the counts, features, base_failed, score and kept of each document."""
    return _counted(docs, keys, trees)


def _counted(docs: DataFrame, keys: list[str], trees: Trees | None) -> DataFrame:
    results = [*COUNTS, "features", "base_failed", "score", "kept"]
    if clash := set(results) & set(keys):
        raise ValueError(f"key columns clash with results: {sorted(clash)}")
    schema = T.StructType([*(docs.schema[k] for k in keys), *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("features", T.ArrayType(T.DoubleType(), False)), T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        for b in common.sliced(batches, "__text"):
            both = [statistics(t) for t in common.texts(b.column(n))]
            counts = np.array([c for c, _ in both], np.int64).reshape(-1, len(COUNTS))
            x = np.array([f for _, f in both]).reshape(-1, len(FEATURES))
            failed = base_failed(counts[:, 0], counts[:, 4])
            scores = trees.scores(x) if trees and len(x) else np.ones(len(x))
            kept = ~failed & (scores >= trees.cut) if trees else ~failed
            at = pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *(pa.array(c) for c in counts.T), pa.ListArray.from_arrays(at, pa.array(x.ravel())), pa.array(failed), pa.array(scores), pa.array(kept)], names=schema.names)

    return docs.select(*keys, F.col("text").alias("__text")).mapInArrow(run, schema)
