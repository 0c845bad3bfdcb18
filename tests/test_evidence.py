"""Evidence, engine codes and the matcher: each rule at its bounds, nulls, ties, repeats, empty tables."""

import pytest
from pyspark.sql import functions as F

from mergewright.functions import engines
from mergewright.operators import evidence, matcher


def told(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [(r.e.name, r.e.state, round(r.e.effect, 6)) for r in df.withColumn("e", column).orderBy("i").collect()]


def test_year_windows_with_open_ends(spark):
    rows = [(1990, 1985, None, False), (1990, None, 1989, False), (1990, None, 1988, False), (1990, None, None, False), (None, 1985, 1990, False), (1990, 1990, 1990, True), (1984, 1985, None, None)]
    c = F.col
    got = told(spark, rows, "y int, a int, b int, o boolean", evidence.year_window("year", c("y"), c("a"), c("b"), c("o")))
    assert got == [("year", "matched", 0.05), ("year_adjacent_unverified", "unverified", -0.05), ("year", "conflicting", -0.2), ("year", "missing", 0), ("year", "none", 0), ("year_month_outside_unverified", "unverified", -0.05), ("year_adjacent_unverified", "unverified", -0.05)]


def test_displacement_doubles_one_way_only(spark):
    rows = [(2616, 1308, True), (1308, 2616, True), (2616, 1308, None), (2400, 2403, False), (2400, 2404, False), (None, 1, True), (1, None, True)]
    got = told(spark, rows, "q int, c int, r boolean", evidence.displacement("cc", F.col("q"), F.col("c"), F.col("r")))
    assert [s for _, s, _ in got] == ["matched", "conflicting", "conflicting", "unverified", "conflicting", "none", "missing"]


def test_power_in_order(spark):
    # (query, candidate, electric, only near, hybrid, units, veteran)
    rows = [(100, 100, 0, 0, 0, 0, 0), (100, 102, 0, 0, 0, 0, 0), (255, 258, 1, 1, 0, 0, 0), (255, 258, 1, 0, 0, 0, 0), (72, 103, 0, 0, 1, 0, 0), (103, 72, 0, 0, 1, 0, 0), (221, 224, 0, 0, 0, 1, 0), (221, 224, 0, 0, 0, 0, 0), (132, 137, 0, 0, 0, 1, 0), (55, 63, 0, 0, 0, 0, 1), (None, 1, 1, 1, 1, 1, 1), (1, None, 1, 1, 1, 1, 1)]
    flag = lambda c: F.col(c) == 1
    e = evidence.power("kw", F.col("q"), F.col("c"), electric=flag("a"), only_near=flag("b"), hybrid=flag("h"), units=flag("u"), veteran=flag("v"))
    got = told(spark, rows, "q int, c int, a int, b int, h int, u int, v int", e)
    assert [n for n, _, _ in got] == ["kw", "kw", "kw_electric_unverified", "kw", "kw_hybrid_unverified", "kw", "kw_horsepower_unit_unverified", "kw", "kw", "kw_veteran_unverified", "kw", "kw"]
    assert [s for _, s, _ in got] == ["matched", "unverified", "unverified", "conflicting", "unverified", "conflicting", "unverified", "conflicting", "conflicting", "unverified", "none", "missing"]


def test_only_near_with_ties_at_the_tolerance(spark):
    types = spark.createDataFrame([("m", 100), ("m", 104), ("m", 104), ("m", 200), (None, 100), (None, 101), ("m", None), ("n", 100)], "k string, kw int")
    near = evidence.neighbours(types, ["k"], "kw")
    assert near.count() == 8
    asked = near.withColumn("q", F.lit(102)).withColumn("o", evidence.only_near(F.col("q"), F.col("kw"), F.col("before_kw"), F.col("after_kw")))
    got = {(r.k, r.kw): r.o for r in asked.collect()}
    # 2 % of 100 and of 104 reach 102 both; of 101 and 100 as well.
    assert got == {("m", 100): False, ("m", 104): False, ("m", 200): False, (None, 100): False, (None, 101): False, ("m", None): False, ("n", 100): True}


def test_fuels_in_order(spark):
    rows = [(["PETROL"], ["PETROL", "DIESEL"], None), (["PETROL", "ELECTRIC"], ["HYBRID PETROL"], []), (["PETROL", "ETHANOL"], ["PETROL"], []), (["PETROL", "LPG"], ["LPG", "PETROL"], []), (["GAS"], ["CNG"], []), (["GAS"], [], ["CNG"]), (["PETROL"], ["DIESEL"], []), (["PETROL"], [], []), (None, ["PETROL"], []), (["PETROL"], None, ["PETROL"])]
    got = told(spark, rows, "q array<string>, c array<string>, k array<string>", evidence.fuels("fuels", F.col("q"), F.col("c"), F.col("k"), [("GAS", "CNG")]))
    assert got == [
        ("fuels", "matched", 0.05), ("fuels", "matched", 0.05), ("fuels_variant_not_confirmed", "unverified", -0.05), ("fuels", "matched", 0.05), ("fuels_compatible_not_confirmed", "unverified", -0.05), ("fuels_compatible_not_confirmed", "unverified", 0),
        ("fuels", "conflicting", -0.15), ("fuels", "missing", 0), ("fuels", "none", 0), ("fuels_compatible_not_confirmed", "unverified", 0),
    ]


def test_relations_of_engine_codes(spark):
    rows = [
        ("BHZ", ["BHZ (DV6FC)"], "engine_code"), ("DV6FC", ["BHZ (DV6FC)"], "engine_code"), ("dv 6-fc", ["BHZ (DV6FC)"], "engine_code"), ("K9K 276", ["K9K"], "engine_code_family"), ("K9K", ["K9K 276"], "engine_code_family"),
        ("K9K 276", ["K9K 636"], "conflict"), ("FB20C", ["FB20"], "engine_code_family"), ("N42 B18 A", ["N42B18"], "engine_code_family"), ("ZZZ99", ["K9K"], "engine_code_unverified"), ("OM 651", ["OM 642"], "conflict"),
        ("L2S, L2S", ["L2S"], "engine_code_list"), ("HF1, HD2", ["HD2", "HF1"], "engine_code_list"), ("HF1, HD2", ["HD2", "HF1", "K9K"], "engine_code_family"), ("HF1, HD9", ["HD2", "HF1"], "engine_code_family"), ("HX1, HD9", ["HD2", "HF1"], "engine_code_unverified"), ("X1", [], "missing"), ("X1", None, "missing"), (None, ["K9K"], None), (" ", ["K9K"], None),
        ("LDD", ["A14XER"], "engine_code_alias"), ("204PT", ["204PT"], "engine_code_family"),
    ]
    known = ["BHZ (DV6FC)", "K9K 276", "K9K 636", "FB20", "N42B18", "OM 651", "OM 642", "HD2", "HF1"]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q string, c array<string>, want string")
    df = engines.with_known(df, "q", spark.createDataFrame([(known,)], "codes array<string>"), "codes")
    aliases = F.when(F.col("q") == "LDD", F.array(F.lit("A14XER")))
    shared = F.when(F.col("q") == "204PT", F.array(F.lit("204PT")))
    got = df.withColumn("got", engines.relation(engines.described(F.col("q")), engines.described_set(F.col("c")), F.col("code_known"), aliases, shared))
    assert [(r.q, r.got) for r in got.orderBy("i").collect()] == [(q, want) for q, _, want in rows]
    electric = df.where("q = 'HF1, HD2'").withColumn("got", engines.relation(engines.described(F.col("q")), engines.described_set(F.col("c")), F.col("code_known"), drivetrain=F.lit(True)))
    assert [r.got for r in electric.orderBy("i").collect()] == ["engine_code", "engine_code_family"]


RECORD = "q_id long, q_maker string, q_model string, q_year int, q_month int, q_fuels array<string>, q_code string, q_cc int, q_kw int, q_drive string, q_body string, q_plug string"
TYPE = "c_id long, c_maker string, c_model string, c_year_from int, c_year_to int, c_month_from int, c_month_to int, c_fuels array<string>, c_parts array<string>, c_codes array<string>, c_cc int, c_kw int, c_drive string, c_bodies array<string>, c_plug string, c_rotary boolean"


def catalogue(spark, rows):
    types = spark.createDataFrame(rows, TYPE)
    return types, types.select("c_id", F.col("c_model").alias("label"))


def test_matcher_on_odd_rows(spark):
    full = ["VOLVO", "XC 60", 2010, 201005, ["DIESEL"], "D5244", 2400, 150, "AWD", "SUV", None]
    rows = [(1, *full), (1, *full), (2, *[None] * 11), (3, "VOLVO", "XC 60", *[None] * 9), (4, "NOBODY", "XC 60", *[None] * 9), (None, *full), (5, "VOLVO", "", *[None] * 9)]
    types, labels = catalogue(spark, [
        (10, "VOLVO", "XC 60", 2008, 2017, None, None, ["DIESEL"], None, ["D5244"], 2400, 150, "AWD", ["SUV"], None, None), (11, "VOLVO", "XC 60", 2008, 2017, None, None, ["PETROL"], None, ["B5254"], 2500, 183, "AWD", ["SUV"], None, None), (12, None, None, *[None] * 13), (13, "VOLVO", "XC 70", *[None] * 13),
    ])
    records = spark.createDataFrame(rows, RECORD)
    got = {r.q_id: (r.top_reference, r.route, r.route_reason) for r in matcher.decided(matcher.scored(records.dropDuplicates(["q_id"]), types, labels), records).collect()}
    assert got[1] == (10, "resolved", "resolved_threshold_met")
    assert got[2] == got[4] == got[5] == (None, "review_required", "no_candidate_above_threshold")
    # Equal types tie for a record that says nothing.
    assert got[3] == (10, "review_required", "candidate_margin_below_gate")
    none = spark.createDataFrame([], RECORD)
    assert matcher.decided(matcher.scored(none, types, labels), none).count() == 0
    empty, no_labels = catalogue(spark, [])
    assert {r.route for r in matcher.decided(matcher.scored(records, empty, no_labels), records).collect()} == {"review_required"}


def test_veterans_power_counts_where_a_plausible_type_has_it(spark):
    def routed(powers):
        types, labels = catalogue(spark, [(i, "VOLVO", "AMAZON", 1956, 1970, None, None, ["PETROL"], None, None, None, p, None, None, None, None) for i, p in enumerate(powers)])
        records = spark.createDataFrame([(1, "VOLVO", "AMAZON", 1965, None, ["PETROL"], None, None, 55, None, None, None)], RECORD)
        return {r.c_id: (r.missing, r.conflicting) for r in matcher.scored(records, types, labels).collect()}

    assert routed([49, 63]) == {0: (["power_kw_veteran_unverified"], []), 1: (["power_kw_veteran_unverified"], [])}
    assert routed([55, 63]) == {0: ([], []), 1: ([], ["power_kw"])}


def test_months_demote_within_a_line_only_beside_one_that_fits(spark):
    def names(months):
        types, labels = catalogue(spark, [(i, "VW", m, 2010, 2016, a, b, None, None, None, None, None, None, None, None, None) for i, (m, a, b) in enumerate(months)])
        records = spark.createDataFrame([(1, "VW", "PASSAT", 2015, 201501, None, None, None, None, None, None, None)], RECORD)
        return {r.c_id: r.missing for r in matcher.scored(records, types, labels).collect()}

    late = ["year_month_outside_unverified"]
    assert names([("PASSAT", 201006, 201412), ("PASSAT B8", 201411, None)]) == {0: late, 1: []}
    assert names([("PASSAT", 201006, 201412), ("PASSAT CC", 201506, None)]) == {0: [], 1: []}


def test_plug_in_guard(spark):
    def reason(plug):
        types, labels = catalogue(spark, [
            (1, "MB", "GLC", 2019, 2022, None, None, ["HYBRID PETROL"], None, None, 1991, 150, None, None, "mild_hybrid", None), (2, "MB", "GLC", 2019, 2022, None, None, ["HYBRID PETROL"], None, None, 1991, 230, None, None, "plug_in_hybrid", None),
        ])
        records = spark.createDataFrame([(1, "MB", "GLC", 2020, None, ["PETROL", "ELECTRIC"], None, 1991, 150, None, None, plug)], RECORD)
        return matcher.decided(matcher.scored(records, types, labels), records).first().reason

    assert (reason(None), reason("hybrid")) == ("candidate_margin_not_met", "automatic_candidate_threshold_met")


@pytest.mark.parametrize(("score", "unverified", "want"), [(0.95, False, "resolved"), (0.95, True, "provisional"), (0.8, True, "provisional"), (0.1, True, "review:score"), (0.95, None, "resolved")])
def test_gates_without_a_gate(spark, score, unverified, want):
    df = spark.createDataFrame([(score, unverified)], "s double, u boolean")
    assert df.select(evidence.gates({"none": F.lit(False)}, F.col("u"), F.col("s")).alias("r")).first().r == want
