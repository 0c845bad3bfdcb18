"""The two quality models: counts against a plain version, monotonicity, held-out accuracy, degenerate labels."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import words
from conftest_llm import rows_by_text

from mergewright.llm import common, nbsvm, quality_trees, queries


def plain_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    inside = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)]


@pytest.mark.parametrize("text", ["", " \n ", "a", "a b c a b c d", "x x x x x", "l1\nl1\n \nl1 \n#*$%&|<>", "a b c\na b c\nz", "é  漢 字\x0bq\x1cr", words(300, 3) + " " + words(300, 3)])
def test_counts(text):
    assert quality_trees.statistics(text)[0] == plain_counts(text)


def test_many_distinct_words_count_the_same():
    ws = ("a b c d " * 20 + "e f").encode().split()
    assert quality_trees.repeat_words(ws) == (80, 6)
    big = [b"%d" % i for i in range(2_000_001)] + [b"x", b"y", b"z", b"x", b"y", b"z"]
    assert quality_trees.repeat_words(big) == (6, 2_000_004)


def test_trees_obey_constraints_and_learn():
    rng = np.random.default_rng(0)
    x = rng.random((1500, len(quality_trees.FEATURES)))
    j = quality_trees.FEATURES.index("repeat_share")
    y = ((x[:, 0] > 0.5) & (x[:, j] < 0.6) ^ (rng.random(1500) < 0.05)).astype(float)
    trees = quality_trees.fit(x, y)
    assert ((trees.scores(x) > 0.5) == y).mean() > 0.9
    for name in quality_trees.MONOTONE:
        k = quality_trees.FEATURES.index(name)
        probe = np.repeat(x[:50], 40, 0)
        probe[:, k] = np.tile(np.linspace(0, 1, 40), 50)
        assert (np.diff(trees.scores(probe).reshape(50, 40), axis=1) <= 1e-12).all()


def test_cut_weighs_both_labels():
    y = np.array([0] * 50 + [1] * 100)
    scores = np.append(np.linspace(0.01, 0.3, 50), np.linspace(0.25, 0.99, 100))
    cut = quality_trees.best_cut(scores, y)
    assert cut == scores[50] and quality_trees.best_cut(scores[:50], y[:50]) == -1.0
    assert quality_trees.best_cut(np.linspace(0.6, 0.9, 4), np.array([0, 1, 0, 1])) == 0.5


def test_sample_is_one_of_rows(spark, docs_of, label_rows):
    rows = [(1, words(60, i % 40), "s") for i in range(400)] + [(d, words(60, d), "s") for d in range(2, 40)]
    sample = common.labelled_sample(docs_of(rows), label_rows([(d, d % 2, 0) for d in range(1, 40)] * 2), 25).collect()
    assert len(sample) == 25 and len({(r.doc_id, r.text) for r in sample}) == 25
    whole = common.labelled_sample(docs_of(rows), label_rows([(1, 1, 0), (1, 0, 0)]), 1000).collect()
    assert len(whole) == (80 if zlib.crc32(b"1") % 3 != 1 else 0)


def test_rules_on_odd_rows(spark, docs_of, odd_rows, label_rows):
    docs = docs_of(odd_rows)
    trees = quality_trees.learn(docs, label_rows([(1, 1, 0), (2, None, 0), (None, 0, 0), (77, 0, 1)]))
    got = quality_trees.score(docs, trees, ["doc_id", "text", "digest"]).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        n = plain_counts(r.text or "")
        assert [r[c] for c in quality_trees.COUNTS] == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and r.kept == (not r.base_failed)
    assert quality_trees.score(docs_of([]), trees, ["doc_id"]).count() == 0
    with pytest.raises(ValueError, match="clash"):
        quality_trees.score(docs, trees, ["score"])


def test_classifier_on_odd_rows_and_labels(spark, docs_of, odd_rows, label_rows):
    docs = docs_of(odd_rows)
    for labels in ([], [(1, 1, 0)], [(None, 1, 0), (2, None, 0)], [(d, d % 2, 0) for d in range(1, 15)] * 2):
        model = nbsvm.learn(docs, label_rows(labels))
        got = nbsvm.score(docs, model, ["doc_id", "size"]).collect()
        assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert nbsvm.score(docs_of([]), model, ["doc_id"]).count() == 0
    assert nbsvm.score(docs, nbsvm.learn(docs_of([]), label_rows([(1, 1, 0)])), ["doc_id"]).first().score == pytest.approx(0.5)


def test_classifier_reruns_agree(spark, docs_of, label_rows):
    rows = [(i, words(40, i) + (" bad!! junk!!" if i % 3 == 0 else ""), "s") for i in range(90)]
    labels = label_rows([(i, int(i % 3 > 0), 0) for i in range(90)])
    one, two = (nbsvm.learn(docs_of(rows).repartition(k), labels) for k in (2, 5))
    assert np.allclose(one.weight, two.weight) and one.slope == pytest.approx(two.slope)


def test_dual_descent_separates():
    rows = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])] * 10
    y = np.array([1, 1, -1, -1] * 10)
    w, b = nbsvm.dual_descent(rows, y, np.array([1.0, -1.0, 0.1, 0.1]), cost=1.0)
    scale = np.array([1.0, -1.0, 0.1, 0.1])
    assert all(np.sign(w[r] @ scale[r] + b) == v for r, v in zip(rows, y, strict=True))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries.op6_quality_nbsvm(spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert len(got) > 80 and np.mean([r.predicted == truth[r.doc_id] for r in got]) > 0.95
    rules = {r.doc_id: r for r in queries.op10_quality_trees(spark, sf).collect()}
    texts = dict(rows_by_text(spark, sf))
    assert all([rules[d][c] for c in quality_trees.COUNTS] == plain_counts(t) for d, t in texts.items())
    late = [r for d, r in rules.items() if d in truth and zlib.crc32(str(d).encode()) % 3 == 1]
    good = [r for r in late if truth[r.doc_id] == 1 and not r.base_failed]
    assert np.mean([r.kept for r in good]) > 0.97
    assert np.mean([r.kept for r in late if truth[r.doc_id] == 0]) < 0.3
