"""Likeness joins against comparing all pairs."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from mergewright.functions import text
from mergewright.operators import similar


def osa(a, b):
    """The distance by a table of all prefixes."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def like(a, b):
    return 1 - osa(a, b) / max(len(a), len(b)) if a or b else 1.0


def made(seed, n, words=1, letters="abcd"):
    rng = random.Random(seed)
    return sorted({" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, words))) for _ in range(n)})


def test_distances_equal_table():
    a, b = made(1, 300, letters="abé🙂"), made(2, 300, letters="abé🙂")
    n = min(len(a), len(b))
    left, right = ["", "", "ab", "ca", *a[:n]], ["", "xyz", "ba", "abc", *b[:n]]
    assert text.osa_similarities(left, right) == pytest.approx([like(x, y) for x, y in zip(left, right, strict=True)])


@pytest.mark.parametrize("bar", [0.6, 0.75, 0.8, 0.9, 1.0])
def test_similar_labels_equal_all_pairs(spark, bar):
    a, b = made(3, 160), made(4, 160)
    df = lambda x, c: spark.createDataFrame([(v,) for v in [*x, *x[:5], None, ""]], f"{c} string")
    got = {(r.a, r.b): round(r.edit, 9) for r in similar.similar_labels(df(a, "l"), "l", df(b, "r"), "r", bar).collect()}
    assert got == {(x, y): round(like(x, y), 9) for x in a for y in b if like(x, y) >= bar - 1e-9}
    assert got


def test_swaps_over_any_place_are_found(spark):
    base = "abcdefghijklmnop"
    swapped = [base[:i] + base[i + 1] + base[i] + base[i + 2 :] for i in range(len(base) - 1)]
    swapped += [s[:j] + "x" + s[j:] for s in swapped for j in range(0, len(s), 3)]
    df = lambda x: spark.createDataFrame([(v,) for v in x], "l string")
    for left, right in ((swapped, [base]), ([base], swapped)):
        got = {(r.a, r.b) for r in similar.similar_labels(df(left), "l", df(right), "l", 0.85).collect()}
        assert got == {(x, y) for x in left for y in right if like(x, y) >= 0.85 - 1e-9}


def score(a, b):
    words = [x.split() for x in (a, b)]
    edit = like(a.replace(" ", ""), b.replace(" ", ""))
    both = len({*words[0]} & {*words[1]}) / len({*words[0], *words[1]})
    s = edit if len(words[0]) == len(words[1]) == 1 else 0.65 * edit + 0.35 * both
    return round(max(s, 0.55) if {*words[0]} < {*words[1]} else s, 6)


@pytest.mark.parametrize("bar", [0.55, 0.7, 0.9])
def test_label_scores_equal_all_pairs(spark, bar):
    a, b = ([x.upper() for x in made(s, 120, 3, "abc")] for s in (5, 6))
    b += [a[0] + " ZZZ", "ZZZ " + a[1], a[2]]
    df = lambda x: spark.createDataFrame([(v,) for v in [*x, None, ""]], "l string")
    got = {(r.a, r.b): r.text_score for r in similar.label_scores(df(a), "l", df(b), "l", bar).collect()}
    want = {(x, y): score(x, y) for x in a for y in {*b} if score(x, y) >= bar - 1e-9}
    assert {k: (got.get(k), want.get(k)) for k in {*got, *want} if abs(got.get(k, 9) - want.get(k, -9)) > 2e-6} == {}


def test_best_label_and_its_ties(spark):
    scores = spark.createDataFrame([("Q", "A B", 0.8), ("Q", "AB", 0.8), ("Q", "AC", 0.8), ("Q", "C D E", 0.9)], "a string, b string, text_score double")
    names = spark.createDataFrame([(1, "A B"), (1, "AB"), (1, "AC"), (2, "C D E"), (2, "AB"), (3, None), (4, "other")], "ref int, label string")
    got = {(r.ref, r.matched_label, r.text_score) for r in similar.best_labels(scores, names, "ref", "label").collect()}
    assert got == {(1, "AC", 0.8), (2, "C D E", 0.9)}


def plain_codes(value):
    out = set()
    for w in re.findall("[A-Z0-9]+", value.upper()):
        if not re.fullmatch("[A-Z]{3,}", w):
            continue
        for x, y in (("PH", "F"), ("SCH", "SK"), ("SH", "S"), ("CH", "K"), ("TH", "T")):
            w = w.replace(x, y)
        w = re.sub("C(?=[EIY])", "S", w)
        if len(w) < 3:
            continue
        groups = {c: k for k, cs in {"P": "BPFVW", "K": "CGJKQX", "T": "DT", "S": "SZ", "": "H"}.items() for c in cs}
        code = "".join(c if i == 0 and c in "AEIOUY" else "" if c in "AEIOUY" else groups.get(c, c) for i, c in enumerate(w))
        out.add(re.sub(r"(.)\1+", r"\1", code))
    return sorted(x for x in out if x)


def test_phonetic_codes_equal_plain(spark):
    values = ["Schmidt Philips", "Chrysler 300C", "Citroën Cyan", "THE SHOW", "ab X", "", "Hyundai hhh", "YAMAHA Kawasaki", "Bobby PUBBV", "Photo-Czech", "oChre Ahh", *(x.upper() for x in made(7, 200, 2, "abchistpyz"))]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.phonetic_codes(F.col("v")).alias("c")).collect()
    assert {r.v: r.c for r in rows} == {v: plain_codes(v) for v in values}


def test_maker_scopes_by_level(spark):
    q = spark.createDataFrame([("VOLVO",), ("VOLVVO",), ("FOLFO",), ("NOBODY KNOWS",), (None,), ("",), ("VOLVO",)], "m string")
    c = spark.createDataFrame([("VOLVO",), ("VOLGA",), ("SAAB",), (None,)], "k string")
    got = {(r.m, r.k, r.scope) for r in similar.maker_scopes(q, "m", c, "k").collect()}
    assert got == {("VOLVO", "VOLVO", "exact_manufacturer"), ("VOLVVO", "VOLVO", "fuzzy_manufacturer"), ("FOLFO", "VOLVO", "phonetic_manufacturer")}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "l string")
    some = spark.createDataFrame([("ABC",)], "l string")
    for x, y in ((none, some), (some, none), (none, none)):
        assert similar.similar_labels(x, "l", y, "l", 0.8).count() == 0
        assert similar.label_scores(x, "l", y, "l").count() == 0
        assert similar.maker_scopes(x.withColumnRenamed("l", "m"), "m", y, "l").count() == 0
    with pytest.raises(ValueError):
        similar.similar_labels(some, "l", some, "l", 0)


def test_pairs_stay_in_proportion(spark):
    """Of all pairs of short labels a few in a thousand meet."""
    import string

    def met(n):
        df = spark.createDataFrame([(v,) for v in made(9, n, 1, string.ascii_lowercase) if len(v) > 5], "l string")
        probes, indexed = similar._probes(df.select(F.col("l").alias("a")), 0.8), similar._indexed(df.select(F.col("l").alias("b")), 0.8)
        return probes.join(indexed, ["__length", "__i", "__text"]).select("a", "b").distinct().count()

    assert met(6000) < 0.005 * 6000**2
