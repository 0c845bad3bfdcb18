"""Near-duplicates against comparing every pair, and the sketch's own properties."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from conftest import words
from conftest_llm import brute_components, rows_by_text

from mergewright.llm import queries, setsketch


def edited(text, changes, seed):
    rng, w = random.Random(seed), text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
    return " ".join(w)


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def want(docs):
    return {d: (n, c, d == c) for d, (n, c) in brute_components(docs).items()}


def test_small_corpora(spark, docs_of):
    base = [words(120, s) for s in range(6)]
    rows = [(100 + i, edited(base[i % 6], i % 5, i), "s") for i in range(60)]
    rows += [(i, base[0], "s") for i in range(5)] + [(50, None, "s"), (51, "", "s"), (52, "A b", "s"), (53, "a B", "s"), (54, "a", "s")]
    assert result(setsketch.near_duplicates(docs_of(rows))) == want([(d, t) for d, t, _ in rows])


def test_blocks_lose_nothing(spark, docs_of, monkeypatch):
    """A large family, with blocks so small that most pairs meet across blocks."""
    base = words(150, 9)
    rows = [(i, edited(base, i % 9, i), "s") for i in range(150)]
    for name, v in (("KEY_BLOCK", 7), ("FAMILY_BLOCK", 11), ("BROADCAST_IDS", 0)):
        monkeypatch.setattr(setsketch, name, v)
    assert result(setsketch.near_duplicates(docs_of(rows))) == want([(d, t) for d, t, _ in rows])


def test_chains_are_one_component(spark, docs_of):
    w = words(100, 5).split()
    rows = [(i, " ".join(w[i:] + [f"t{k}" for k in range(i)]), "s") for i in range(0, 60, 3)]
    got = result(setsketch.near_duplicates(docs_of(rows)))
    assert got == want([(d, t) for d, t, _ in rows])


def test_ids_of_any_size(spark, docs_of):
    rows = [((1 << 62) + 5, words(60, 1), "s"), ((1 << 62) + 9, words(60, 1), "s"), (-7, words(60, 2), "s"), (None, words(60, 1), "s"), (None, words(60, 3), "s"), (None, None, "s")]
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in setsketch.near_duplicates(docs_of(rows)).collect())
    assert got == sorted([((1 << 62) + 5, (1 << 62) + 5, True), ((1 << 62) + 9, (1 << 62) + 5, False), (-7, -7, True), (0, (1 << 62) + 5, False), (0, 0, True), (0, 0, True)])
    rows = [((1 << 63) - 1, words(60, 1), "s"), ((1 << 63) - 2, words(60, 1), "s")]
    assert result(setsketch.near_duplicates(docs_of(rows))) == want([(d, t) for d, t, _ in rows])


def test_odd_rows(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows)
    got = setsketch.near_duplicates(docs).collect()
    assert len(got) == len(odd_rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[2].component_id == 1 and by[11].component_id == by[12].component_id == 11 and by[14].component_id == 14 and by[4].kept and by[4].n_shingles == 0
    nameless = [r for r in got if r.doc_id is None]
    assert sorted((r.component_id is None, r.kept) for r in nameless) == [(False, False), (True, True), (True, True)]
    stays = setsketch.without_near_duplicates(docs)
    assert stays.columns == docs.columns
    ids = sorted(r.doc_id for r in stays.collect() if r.doc_id is not None)
    assert ids == [1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 14] and stays.where("doc_id IS NULL").count() == 2


def test_empty(spark, docs_of):
    assert setsketch.near_duplicates(docs_of([])).count() == 0
    assert setsketch.without_near_duplicates(docs_of([])).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 64, 3000, np.uint64)
    a, b = pool[:2000], pool[600:2600]
    ka, kb = setsketch.sketch(a), setsketch.sketch(b)
    assert (setsketch.sketch(np.union1d(a, b)) == np.maximum(ka, kb)).all()
    guesses = []
    for i in range(40):
        x = setsketch._mixed(pool + np.uint64(i))
        k, m = setsketch.sketch(x[:2000]), setsketch.sketch(x[600:2600])
        guesses.append(setsketch.estimate(np.array([(k > m).sum()]), np.array([(k < m).sum()]), np.array([(k == m).sum()]), np.array([2000]), np.array([2000]))[0])
    assert abs(np.mean(guesses) - 1400 / 2600) < 0.03
    assert setsketch.estimate(np.array([0]), np.array([0]), np.array([128]), np.array([10]), np.array([10]))[0] > 0.99


def test_intersections():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 50, 30)).astype(np.uint64) for _ in range(9)]
    got = setsketch.intersections(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(9) for j in range(9) if i != j)


def peak_mb(work):
    tracemalloc.start()
    try:
        out = work()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_blocks_of_near_copies_take_little_memory():
    """Groups as large as they get, in which all pairs are links."""
    g = 2 * setsketch.FAMILY_BLOCK
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 62, 60)).astype(np.uint64)
    sets = [np.unique(np.append(base, np.uint64(i))) for i in range(g)]
    block = (np.arange(g) % 2).astype(np.int32)
    t = pa.table({"id": np.arange(g), "block": block, "i": np.zeros(g, np.int32), "j": np.ones(g, np.int32), "hashes": [x.tobytes() for x in sets]})
    links, mb = peak_mb(lambda: setsketch._linked(t, np.array([0]), np.array([g])))
    assert mb < 90
    assert links.column("a").to_pylist() == list(range(1, g)) and set(links.column("b").to_pylist()) == {0}

    g = 2 * setsketch.KEY_BLOCK
    r = setsketch.sketch(base).tobytes()
    groups = 12
    t = pa.table({"id": np.arange(g * groups), "n": np.full(g * groups, 60), "block": np.zeros(g * groups, np.int32), "i": np.zeros(g * groups, np.int32), "j": np.zeros(g * groups, np.int32), "registers": [r] * (g * groups)})
    links, mb = peak_mb(lambda: setsketch._alike(t, np.arange(groups) * g, np.full(groups, g)))
    assert mb < 90
    assert links.num_rows == groups * (g - 1) and all(b == a // g * g for a, b in zip(links.column("a").to_pylist(), links.column("b").to_pylist(), strict=True))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    assert result(queries.op4_setsketch_dedup(spark, sf)) == want(rows_by_text(spark, sf))


def test_ids_at_both_ends_beside_rows_without_one(spark, docs_of):
    top, low, a = (1 << 63) - 5, -(1 << 63), words(60, 1)
    rows = [(top, a, "s"), (low, words(60, 2), "s"), (3, words(60, 3), "s"), (None, a, "s"), (None, words(60, 4), "s"), (top - 9, words(60, 3) + " more", "s")]
    got = {(r.doc_id, r.component_id, r.kept) for r in setsketch.near_duplicates(docs_of(rows)).collect()}
    assert got == {(low, low, True), (3, 3, True), (top - 9, 3, False), (top, top, True), (None, top, False), (None, None, True)}
