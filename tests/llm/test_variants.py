"""Spelling variants against comparing every word with every other."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from mergewright.llm import queries, variants


def brute(docs):
    """word to (form, root, n, n_near, form_n); docs: (doc_id, text)."""
    counts = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 199 == 0:
                i = h % len(w)
                w = w[:i] + w[i + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [] for w in words}
    holes = {}
    for w in words:
        for i in range(len(w)):
            holes.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
    pairs = {(a, b) for group in holes.values() for a in group for b in group if a != b and len(a) == len(b)}
    pairs |= {(w, s) for w in words for i in range(len(w)) if (s := w[:i] + w[i + 1 :]) in words}
    for a, b in pairs | {(b, a) for a, b in pairs}:
        near[a].append(b)
    forms = {}
    for w, ns in near.items():
        best = min(((-words[x], x) for x in ns), default=None)
        forms[w] = best[1] if best and -best[0] >= 5 * words[w] else None
    out = {}
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, words[w], len(near[w]), words.get(forms[w]))
    return out


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def made_docs():
    """Words with frequent and rare spellings, chains of forms, ties, letters of all of the range."""
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdeéÿÀß×") for _ in range(rng.randint(6, 9))) for _ in range(60)]
    bag = []
    for w in base:
        bag += [w] * 150
        for _ in range(4):
            i, kind = rng.randrange(len(w)), rng.randrange(3)
            v = w[:i] + {0: "", 1: rng.choice("abxéÿ"), 2: rng.choice("abxéÿ") + w[i]}[kind] + w[i + 1 :]
            bag += [v] * rng.choice((5, 6, 26, 30))
            j = rng.randrange(len(v))
            bag += [v[:j] + v[j + 1 :]] * 5
    bag += ["lonelyword"] * 9
    rng.shuffle(bag)
    return [(i, " ".join(bag[i::40]).replace("a", "A") if i % 2 else ", ".join(bag[i::40])) for i in range(40)]


def test_words_equal_brute_force(spark, docs_of):
    docs = made_docs()
    got, want = found(variants.group_variants(docs_of([(d, t, "s") for d, t in docs]))), brute(docs)
    assert got == want
    assert any(v[0] and v[1] != v[0] for v in want.values()) and any(v[3] == 0 for v in want.values())


@pytest.mark.parametrize("bits", [64, 1 << 12])
def test_crowded_filters_change_nothing(spark, docs_of, bits):
    docs = made_docs()
    assert found(variants.group_variants(docs_of([(d, t, "s") for d, t in docs]), bits)) == brute(docs)


def test_odd_rows(spark, docs_of, odd_rows):
    rows = odd_rows + [(i, "z" * 3000 + " " + "z" * 2999 + "y tiewordaa tiewordbb tiewordcc", "s") for i in range(20, 26)]
    rows += [(40 + i, "tiewordbb tiewordcc " * 5, None) for i in range(5)]
    assert found(variants.group_variants(docs_of(rows))) == brute([(d, t) for d, t, _ in rows])
    assert variants.group_variants(docs_of([])).count() == 0
    assert variants.group_variants(docs_of([(1, None, None)])).count() == 0


def test_probe_finds_each_pair_from_one_side():
    words = ["abcdef", "abcdeg", "abcde", "abcdefg", "zbcdef"]
    filters = variants.Filters({n: len(at) for n, at in variants.by_length(words).items()})
    for length, at in variants.by_length(words).items():
        block, bits = filters.place(variants.hashes([words[i] for i in at]), length)
        np.bitwise_or.at(filters.blocks, block, bits)
    name = dict(zip(variants.hashes(words).tolist(), words, strict=True))
    a, b = variants.probe(words, filters)
    pairs = {(name[x], name[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True) if y in name}
    assert {("abcdef", "abcdeg"), ("abcdefg", "abcdef"), ("abcdef", "zbcdef"), ("abcdefg", "abcdeg")} >= pairs >= {("abcdef", "abcdeg"), ("abcdefg", "abcdef"), ("abcdef", "zbcdef")}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries.QUERIES["op13_spelling_variants"](spark, sf)) == brute(rows)
