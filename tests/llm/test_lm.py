"""The suffix tree: probabilities, states, and the base score against a plain version."""

import math
import os
import random
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from conftest import words
from conftest_llm import rows_by_text
from pyspark.sql import functions as F

from mergewright.llm import common, queries, suffix_tree


def plain_base(docs, held):
    c = Counter()
    for d, t in docs:
        if not held(d):
            c.update((t or "").encode().lower().split())
            c[None] += 1
    n, v = sum(c.values()), len(c)
    out = []
    for d, t in docs:
        tokens = [*(t or "").encode().lower().split(), None]
        out.append((d, held(d), len(tokens), sum(c[w] > 0 for w in tokens), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)))
    return out


def held(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1


def held_column():
    return F.pmod(common.id_crc(), F.lit(5)) == 1


def key(r):
    return (r[0] is None, r[0] or 0, r[2], r[5])


def same(got, docs):
    want = sorted(plain_base(docs, held), key=key)
    got = sorted(([r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score] for r in got), key=key)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == list(w[:5]) and g[5] == pytest.approx(w[5], rel=1e-9)


def test_spent_broadcasts_leave_the_disk(spark, docs_of):
    folder = spark.sparkContext._temp_dir
    before = set(os.listdir(folder))
    suffix_tree.learn(docs_of([(i, words(40, i % 3), "s") for i in range(12)]))
    assert set(os.listdir(folder)) <= before


def test_documents_are_scored_in_shares_and_spent_shuffles_leave_the_disk(spark, docs_of, monkeypatch):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffles = lambda: {f for d in folders for f in Path(d).glob("*/shuffle_*.data")}
    before, kept, stored = shuffles(), [], common.stored

    def keeping(df, name):
        # Nothing is collected while it is kept here.
        kept.append((name, df, stored(df, name)))
        return kept[-1][2]

    monkeypatch.setattr(common, "stored", keeping)
    monkeypatch.setattr(common, "let_go", lambda spark: None)
    monkeypatch.setattr(suffix_tree, "HEAD", 50)
    rows = [(i, words(40, i % 9), "s") for i in range(60)]
    same(suffix_tree.learn_and_score(docs_of(rows), held_column()).collect(), [(d, t) for d, t, _ in rows])
    shares = [out.count() for name, _, out in kept if name == "scores"]
    assert len(shares) == suffix_tree.PASSES and sum(shares) == len(rows) and max(shares) < 0.75 * len(rows)
    # The counts above leave one each, and files go a little later than their query ends.
    end = time.time() + 10
    while shuffles() - before and time.time() < end:
        time.sleep(0.2)
    left = shuffles() - before
    assert len(left) <= len(shares), left


def test_packs_in_planes():
    gram, n, x = np.arange(5, dtype=np.uint64) << np.uint64(33), np.arange(5, dtype=np.int8), np.linspace(-1, 1, 5)
    packs = suffix_tree._packs([(1, 0, tuple(suffix_tree._planes(v[s]) for v in (gram, n, x))) for s in (slice(0, 3), slice(3, 5))]).column("pack").to_pylist()
    got = suffix_tree._unpacked(packs, np.uint64, np.int8, np.float64, planes=True)
    assert all((g == w).all() for g, w in zip(got, (gram, n, x), strict=True))


def test_odd_rows(spark, docs_of, odd_rows):
    got = suffix_tree.learn_and_score(docs_of(odd_rows), held_column()).collect()
    same(got, [(d, t) for d, t, _ in odd_rows])
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)


def test_small_head_changes_nothing_of_the_base(spark, docs_of, monkeypatch):
    rows = [(i, words(40, i % 9), "s") for i in range(60)]
    one = {r.doc_id: r.score for r in suffix_tree.learn_and_score(docs_of(rows), held_column()).collect()}
    monkeypatch.setattr(suffix_tree, "HEAD", 50)
    got = suffix_tree.learn_and_score(docs_of(rows), held_column()).collect()
    same(got, [(d, t) for d, t, _ in rows])
    assert len(one) == len(got)


def test_contexts_help_and_probabilities_sum_to_one(spark, docs_of):
    rows = [(i, "alpha beta gamma delta " * 10 if i % 2 else "beta alpha delta gamma " * 10, "s") for i in range(80)]
    docs = docs_of(rows)
    model = suffix_tree.learn(docs.where(~held_column()))
    tree = model.tree
    assert len(tree.keys) > 0
    got = suffix_tree.score(docs, model, held_column()).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.5 * got[1]
    counts = {np.int64(r.gram).view(np.uint64): r.c for r in model.words.collect()}
    assert set(counts) == {suffix_tree.END_KEY, *(suffix_tree.key_of(w) for w in (b"alpha", b"beta", b"gamma", b"Delta"))}
    for before in ([], [b"alpha"], [b"alpha", b"beta"], [b"never"]):
        x = [suffix_tree.START_KEY, *map(suffix_tree.key_of, before)]
        total = 10 ** tree.scores([*x, suffix_tree.key_of(b"unknown")], np.append(np.zeros(len(x) - 1), model.unknown))[-1]
        for s, c in counts.items():
            total += 10 ** tree.scores([*x, s], np.append(np.zeros(len(x) - 1), float(model.root_log(c))))[-1]
        assert total == pytest.approx(1, abs=1e-6)


def test_keys_are_those_of_single_words():
    texts = ["", None, "a  B\tc", "x" * 7 + " " + "y" * 8 + " " + "z" * 9, "é" * 40 + " " + "long" * 500 + " end", " \n", "Ünï\u00a0ç 🙂", "tail", "w" * 256 + " " + "w" * 257 + " " + "w" * 255]
    x, place = suffix_tree.symbols(pa.array([None, "skip", *texts])[2:])
    want, places = [], []
    for t in texts:
        own = [suffix_tree.START_KEY, *map(suffix_tree.key_of, common.words(t or "")), suffix_tree.END_KEY]
        want += own
        places += range(len(own))
    assert x.tolist() == [int(k) for k in want] and place.tolist() == places
    many = {suffix_tree.key_of(b"%d" % i) for i in range(3000)} | {suffix_tree.key_of(b"x" * i) for i in range(1, 600)}
    assert len(many) == 3599 and suffix_tree.key_of(b"ABC") == suffix_tree.key_of(b"abc")


def test_lookup_finds_all_and_no_others():
    keys = np.sort(suffix_tree.mixed(np.arange(5000, dtype=np.uint64)))
    assert suffix_tree.Lookup(keys)(keys).tolist() == list(range(5000))
    assert (suffix_tree.Lookup(keys)(keys + np.uint64(1)) < 0).all() and (suffix_tree.Lookup(keys[:0])(keys) < 0).all()


def test_without_training_texts_or_rows(spark, docs_of):
    only_held = [(d, "a b c", "s") for d in range(60) if held(d)]
    got = suffix_tree.learn_and_score(docs_of(only_held), held_column()).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0 for r in got) and len(got) == len(only_held)
    assert suffix_tree.learn_and_score(docs_of([]), held_column()).count() == 0


def test_query_beats_the_base(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op3_suffix_tree_lm(spark, sf).collect()
    same(got, rows_by_text(spark, sf))
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def plain_scores(docs, held, depth=4, least=4):
    """The tree's scores by dictionaries, with chains of suffixes."""
    texts = {d: ["<", *(t or "").encode().lower().split(), ">"] for d, t in docs}
    train = [x for d, x in texts.items() if not held(d)]
    runs = [Counter(tuple(x[i - k : i + 1]) for x in train for i in range(k, len(x))) for k in range(depth + 1)]
    c = Counter(w for x in train for w in x[1:])
    n, once, twice = sum(c.values()), *(sum(v == m for w, v in c.items() if w != ">") for m in (1, 2))
    discount = min(max(once / (once + 2 * twice) if once else 0, 0.05), 0.95)
    states = {}

    def probability(context, s):
        while context and context not in states:
            context = context[1:]
        if not context:
            return ((c[s] - discount) if c[s] else discount * len(c)) / n
        rest, own = states[context]
        return own[s] if s in own else rest * probability(context[1:], s)

    for k in range(1, depth + 1):
        nexts, found = {}, {}
        for g, m in runs[k].items():
            if m >= least:
                nexts.setdefault(g[:-1], {})[g[-1]] = m
        for context, counts in nexts.items():
            count = runs[k - 1][context]
            rest = 1 - sum(m - 0.75 for m in counts.values()) / count
            own = {s: (m - 0.75) / count + rest * probability(context[1:], s) for s, m in counts.items()}
            gain = sum(m * math.log(own[s] / probability(context[1:], s)) for s, m in counts.items()) + (count - sum(counts.values())) * math.log(rest)
            if gain > 10 + 2 * len(counts):
                found[context] = rest, own
        states |= found
    return {d: sum(math.log10(probability(tuple(x[max(0, i - depth) : i]), x[i])) for i in range(1, len(x))) for d, x in texts.items()}, states


def corpus():
    rng = random.Random(5)
    lines = [" ".join(rng.choices("ab cd ef gh ij kl".split(), k=14)) for _ in range(40)]
    return [(i, " ".join(lines[(i * 7 + j * j) % 40] + " " + words(3, i * 10 + j) for j in range(6)), "s") for i in range(90)]


@pytest.mark.parametrize("hot", [2_000_000, 40, 0])
def test_scores_equal_plain_tree(spark, docs_of, monkeypatch, hot):
    monkeypatch.setattr(suffix_tree, "HOT", hot)
    monkeypatch.setattr(suffix_tree, "HEAD", 60 if hot == 40 else 200_000)
    rows = corpus()
    want, states = plain_scores([(d, t) for d, t, _ in rows], held)
    assert {len(c) for c in states} == {1, 2, 3, 4}
    got = suffix_tree.learn_and_score(docs_of(rows), held_column()).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id], rel=1e-9)


def test_bar_does_not_grow_with_the_corpus(spark, docs_of):
    """Beyond a million training tokens a context that comes five times is still a state."""
    rows = [(i, words(6, 7) + " " + words(20, 1000 + i), "s") for i in range(60) if not held(i)][:5]
    big = [(i, "filler " * 600_000, "s") for i in range(100, 120) if not held(i)][:3]
    docs = docs_of([*rows, *big])
    model = suffix_tree.learn(docs.where(~held_column()))
    assert model.tokens > 1_500_000
    a, b = map(suffix_tree.key_of, words(6, 7).encode().split()[:2])
    got = model.tree.scores([suffix_tree.START_KEY, a, b], np.append(0.0, model.root_log(5)))
    assert 10 ** got[-1] > 0.5
    want, _ = plain_scores([(d, t) for d, t, _ in [*rows, *big]], held)
    for r in suffix_tree.score(docs, model, held_column()).collect():
        assert r.score == pytest.approx(want[r.doc_id], rel=1e-6)


def test_runs_are_counted_in_shares_of_their_keys(spark, docs_of, monkeypatch):
    texts = docs_of([(i, words(60, i), "s") for i in range(30)]).select("text")
    sent, count = [], suffix_tree.count_runs

    def counting(*args, **more):
        sent.append(count(*args, **more))
        return sent[-1]

    def twos(x, place):
        at = np.flatnonzero(place >= 1)
        return [(x[at - 1], x[at])]

    monkeypatch.setattr(suffix_tree, "count_runs", counting)
    rows = lambda df: sorted(map(tuple, df.select("gram", "prefix", "suffix", "n").collect()))
    got, want = rows(suffix_tree.counted(texts, twos, 1, 16)), rows(count(texts, twos, [1], 16))
    assert got == want and len(want) > 100
    shares = [df.count() for df in sent]
    assert len(shares) == suffix_tree.PASSES and max(shares) < 0.75 * len(want)
