"""Water-filling and seeded repetitions, against a plain version."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from mergewright.llm import mixing


def plain_mix(rows, seed=17, weights=(3, 1, 2), epochs=2):
    """(doc index) to repetitions, and targets by source."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    own = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in sources}
    weight = {s: weights[i % 3] for i, s in enumerate(sources)}
    left, open_, target = sum(size) * 1.5, set(sources), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= epochs * own[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = float(epochs * own[s])
            left -= target[s]
        open_ -= over
    out = [0] * len(rows)
    for s in sources:
        whole = int(target[s] // own[s]) if own[s] else 0
        rest = target[s] - whole * own[s]
        draw = {i: hashlib.md5(f"{seed}:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest() for i in range(len(rows)) if rows[i][2] == s}
        before, taken = 0, set()
        for h in sorted(set(draw.values())):
            n = sum(size[i] for i in draw if draw[i] == h)
            if 2 * before + n < 2 * rest:
                taken.add(h)
            before += n
        for i in draw:
            out[i] = whole + (draw[i] in taken) if size[i] else 0
    return out, size, target


def test_odd_rows(spark, docs_of, odd_rows):
    want, size, target = plain_mix(odd_rows)
    rows = mixing.slim(docs_of(odd_rows))
    got = mixing.repeats(rows, mixing.plan(rows)).collect()
    key = lambda d, s, n: (d is None, d or 0, s or "", n)
    assert sorted((*key(r.doc_id, r.source, r.size), r.repeats if r.size else 0) for r in got) == sorted((*key(d, s, n), w) for (d, _, s), n, w in zip(odd_rows, size, want, strict=True))
    for r in got:
        assert r.mix_target == pytest.approx(target[r.source], rel=1e-12)


def test_targets_are_met_and_reruns_agree(spark, docs_of):
    from conftest import words

    rows = [(i, words(1 + i * 7 % 90, i), f"s{min(i % 7, 3)}") for i in range(400)]
    docs = docs_of(rows)
    plan = mixing.plan(mixing.slim(docs))
    one = mixing.repeats(mixing.slim(docs), plan)
    sums = one.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("n"), F.first("mix_target").alias("t")).collect()
    assert all(abs(r.n - r.t) <= 90 for r in sums) and one.agg(F.max("repeats")).first()[0] <= 2
    again = mixing.repeats(mixing.slim(docs.repartition(5)), mixing.plan(mixing.slim(docs.repartition(3))))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, again.collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == one.agg(F.sum("repeats")).first()[0]


def test_many_sources_take_the_other_join(spark, docs_of, odd_rows, monkeypatch):
    rows = mixing.slim(docs_of(odd_rows))
    want = sorted(map(str, mixing.repeats(rows, mixing.plan(rows)).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.repeats(rows, mixing.plan(rows)).collect())) == want


def test_empty(spark, docs_of):
    assert mixing.mix(docs_of([])).count() == 0
    nothing = docs_of([(1, None, "a"), (2, "", None)])
    assert mixing.mix(nothing).count() >= 0
