"""Class-conditional Kneser-Ney: against plain dictionaries, held-out accuracy, odd rows."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from mergewright.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def brute(docs, labels):
    """doc_id to (toxic_ll, ordinary_ll) by dictionaries; docs: (doc_id, text), labels: (doc_id, toxic)."""
    def words(t):
        return [w for x in (t or "").encode().lower().split() if (w := x.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))]

    def start(w):
        return w.decode()[:5] if len(w.decode()) >= 5 else None

    text = dict(docs)
    fit = [(words(text[d]), y) for d, y in labels if zlib.crc32(str(d).encode()) % 5 and zlib.crc32(b"curve:%d" % d) % 5]
    n = defaultdict(int)
    for ws, _ in fit:
        for w in ws:
            n[w] += 1
            n[start(w)] += 1
    entry = lambda w: w if n.get(w, 0) >= 3 else ("~", start(w)) if start(w) and n.get(start(w), 0) >= 3 else "?"
    before = [defaultdict(set), defaultdict(set)]
    for ws, y in fit:
        last = "^"
        for e in map(entry, ws):
            before[y][e].add(last)
            last = e
    size = [{e: len(s) for e, s in b.items()} for b in before]
    both = {e: size[0].get(e, 0) + size[1].get(e, 0) for e in {*size[0], *size[1]}}
    entries = 1 + sum(1 for w, c in n.items() if w is not None and c >= 3)

    def cut(values):
        ones, twos = sum(v == 1 for v in values), sum(v == 2 for v in values)
        return ones / (ones + 2 * twos) if ones and twos else 0.5

    d0, ds = cut(both.values()), [cut(s.values()) for s in size]
    shared = lambda e: (max(both.get(e, 0) - d0, 0) + d0 * len(both) / entries) / sum(both.values())
    p = lambda e, y: (max(size[y].get(e, 0) - ds[y], 0) + ds[y] * len(size[y]) * shared(e)) / sum(size[y].values())
    return {d: tuple(np.mean([math.log(p(e, y)) for e in map(entry, words(t))]) if words(t) else 0.0 for y in (1, 0)) for d, t in docs}


def test_likelihoods_equal_dictionaries(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    want = brute(docs, labels)
    rows = queries.QUERIES["op12_toxicity_kn"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.toxic_ll, r.ordinary_ll) == pytest.approx(want[r.doc_id], abs=1e-5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES["op12_toxicity_kn"](spark, SF).collect() if r.held_out and r.doc_id in truth]
    hit = sum(r.predicted for r in rows if truth[r.doc_id]) / sum(truth[r.doc_id] for r in rows)
    wrong = sum(r.predicted for r in rows if not truth[r.doc_id]) / sum(1 - truth[r.doc_id] for r in rows)
    assert hit > 0.9 and wrong < 0.01, (hit, wrong)


def test_odd_rows_and_labels(spark, docs_of, odd_rows, label_rows):
    docs = docs_of(odd_rows)
    labels = label_rows([(1, 1, 1), (2, 1, 0), (3, 0, None), (None, 1, 1), (7, 0, 0), (9, 1, 0), (13, None, 1), (99, 1, 1), (1, 1, 1), (4, 1, 1), (5, 0, 0)])
    got = toxicity.score(docs, toxicity.learn(docs, labels), ["doc_id", "label", "rank"])
    rows = got.collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    empty = {r.score for r in rows if r.doc_id in (4, 5, 6)}
    assert len(empty) == 1 and len({r.score for r in rows if r.doc_id == 3}) == 1
    with pytest.raises(ValueError):
        toxicity.score(docs, toxicity.learn(docs, labels), ["score"])


def test_one_class_no_labels_empty_tables(spark, docs_of, odd_rows, label_rows):
    docs = docs_of(odd_rows)
    for labels, low, high in [([(1, 1, 1), (2, 1, 1), (7, 0, 1)], 0.5, 1), ([(1, 1, 0), (2, 1, 0), (7, 0, 0)], 0, 0.5), ([], 0.5, 0.5), ([(4, 0, 1), (5, 0, 0)], 0, 1)]:
        scores = {r.score for r in toxicity.score(docs, toxicity.learn(docs, label_rows(labels)), ["doc_id"]).collect()}
        assert len(scores) == 1 and low <= scores.pop() <= high
    none = docs_of([])
    assert toxicity.score(none, toxicity.learn(none, label_rows([(1, 1, 1)])), ["doc_id"]).count() == 0


def test_few_words_still_score(spark, docs_of, label_rows):
    rows = [(i, ("foul " if i % 4 == 0 else "fair ") + "some ordinary words stand here", "s") for i in range(200)]
    docs, labels = docs_of(rows), label_rows([(i, 1, int(i % 4 == 0)) for i in range(200)])
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.learn(docs, labels, words=12), ["doc_id"]).collect()}
    assert got == {i: int(i % 4 == 0) for i in range(200)}


def test_discounts_and_shares_sum_to_one():
    contexts = np.array([[5, 1, 0, 2, 1, 0], [1, 1, 2, 0, 7, 0]], float)
    assert np.exp(toxicity.kneser_ney(contexts)).sum(1) == pytest.approx([1, 1])
