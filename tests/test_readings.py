"""Grammars and readings: order, bounds, quantifiers, nulls and empty tables."""

import pytest
from pyspark.sql import functions as F

from mergewright.operators.grammar import Alternative, Take, compile_grammar
from mergewright.operators.readings import decide
from mergewright.plans.grammars import TYRE, TYRES, cleaned_tyre


def test_first_alternative_within_bounds(spark):
    rules = [
        Alternative("narrow", r"^([0-9]+)-(A|B)", {"n": [Take(1)], "kind": [Take(2, table={"A": "first"}, other="other")]}, {"n": (5, 9)}),
        Alternative("wide", r"([0-9]+)", {"n": [Take(1)], "kind": [Take(1, words={"77": "lucky"}), Take(constant="plain")]}),
    ]
    texts = ["7-A tail", "7-B", "3-A", "x77y", "", None, "none", "99999999999-A"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.g and (r.g.alternative, r.g.n, r.g.kind, r.g.rest) for r in df.select("i", compile_grammar(F.col("t"), rules, {"n": "int", "kind": "string"}).alias("g")).orderBy("i").collect()]
    assert got == [("narrow", 7, "first", "tail"), ("narrow", 7, "other", None), ("wide", 3, "plain", "-A"), ("wide", 77, "lucky", "x y"), None, None, None, ("wide", None, "plain", "-A")]
    with pytest.raises(ValueError):
        compile_grammar(F.col("t"), rules, {"n": "int"})


def test_tyres_as_written(spark):
    want = {
        "205/55 R16 91V": ("metric", 205, 55, 16.0, 91, "V", None), "P 215/65SR15": ("metric", 215, 65, 15.0, None, "S", None), "195/70R15C 104/102R": ("metric", 195, 70, 15.0, 104, None, "c"), "255/35 ZR 19 (96) Y XL": ("metric", 255, 35, 19.0, 96, "Y", "xl"), "HL 245/40R21": ("metric", 245, 40, 21.0, None, None, "hl"),
        "165 R 13": ("alpha", 165, None, 13.0, None, None, None), "5,60 - 15": ("imperial", None, None, 15.0, None, None, None), "7.25R13/4": ("imperial_full", None, None, 13.0, None, None, None), "3.25-16": ("imperial", None, None, 16.0, None, None, None), "29.04-14": None, "axle": None, " ": None, "D78-14": ("alphanumeric", None, 78, 14.0, None, None, None), "165-340": ("mm_rim", 165, None, None, None, None, None),
    }
    df = spark.createDataFrame([(t,) for t in [*want, None]], "t string")
    rows = df.select("t", compile_grammar(cleaned_tyre(F.col("t")), TYRES, TYRE).alias("g")).collect()
    got = {r.t: r.g and (r.g.alternative, r.g.section_width_mm, r.g.aspect_ratio, r.g.rim_diameter_in, r.g.load_index, r.g.speed_symbol, r.g.load_range) for r in rows}
    assert got == want | {None: None}


READ = "k int, position int, name string, type string"


def decided(spark, rows, answers, guards):
    asked = []

    def evaluate(distinct):
        asked.extend((r.name, r.type) for r in distinct.collect())
        known = spark.createDataFrame(answers, "name string, type string, reference string, route string, confidence double, conflicts boolean")
        return distinct.join(known, distinct["name"].eqNullSafe(known["name"]) & distinct["type"].eqNullSafe(known["type"]))

    got = decide(spark.createDataFrame(rows, READ), "k", ["name", "type"], evaluate, guards).collect()
    return asked, {r.k: (r.position, r.reference, r.route, r.replaced, r.held) for r in got}


def test_winner_replacement_and_guards(spark):
    answers = [("a", None, "A", "resolved", 0.9, False), ("b", "t", "B", "resolved", 0.95, False), ("c", "t", "C", "resolved", 0.99, True), ("p", None, "A", "provisional", 0.8, False), ("", "t", "E", "provisional", 0.75, False)]
    rows = [(1, 0, "a", None), (1, 1, "p", None), (2, 0, "a", None), (2, 1, "b", "t"), (3, 0, "c", "t"), (3, 1, "a", None), (4, 0, "c", "t"), (4, 1, "p", None), (5, 0, "nothing", None), (6, 0, "a", None), (6, 1, "a", None), (7, 0, "", "t"), (7, 1, None, "t"), (8, 1, "a", None), (8, 0, "a", None)]
    other = F.col("s.reference") != F.col("w.reference")
    guards = {"contested": ("any", other & (F.col("s.route") == "resolved")), "all_other": ("all", other), "no_second": ("none", F.lit(True))}
    asked, got = decided(spark, rows, answers, guards)
    assert len(asked) == len({*asked}) == 7
    assert got == {
        1: (0, "A", "resolved", False, []), 2: (1, "B", "review_required", False, ["contested", "all_other"]), 3: (1, "A", "review_required", True, ["contested", "all_other"]), 4: (0, "C", "review_required", False, ["all_other"]),
        5: (0, None, "review_required", False, ["no_second"]), 6: (0, "A", "resolved", False, []), 7: (0, "E", "provisional", False, []), 8: (0, "A", "resolved", False, []),
    }
    assert decided(spark, [], answers, guards)[1] == {} and decided(spark, rows[:1], [], {})[1] == {1: (0, None, "review_required", False, [])}
    with pytest.raises(ValueError):
        decided(spark, rows, answers, {"x": ("most", other)})
