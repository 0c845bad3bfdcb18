"""Evidence of a pair of records, its confidence, eligibility and routing, as columns.

An evidence is a struct of name, state and effect on the score. States: matched, conflicting, unverified (neither), missing
(the candidate doesn't say) and none (the query doesn't say, so nothing is compared). A null condition doesn't hold. Names
of unverified evidence say why (power_kw_hybrid_unverified); weights, tolerances and bars are fixed values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a scope of makers is worth in the confidence (fixed values); any other is worth nothing.
SCOPE_SIGNAL = {"exact_manufacturer": 1.0, "fuzzy_manufacturer": 0.65, "phonetic_manufacturer": 0.5}
MARGIN, RESOLVED, PROVISIONAL, PLAUSIBLE = 0.08, 0.90, 0.70, 0.55
#: Kilowatts of a metric and of an American horsepower, and how far two roundings may be apart (fixed values).
KW_PER_PS, KW_PER_HP, UNIT_SLACK = 0.7355, 0.7457, 1.01
#: Makers whose power may be given in either unit (fixed values).
UNIT_MAKERS = ["FORD USA", "CHEVROLET", "DODGE", "CHRYSLER", "JEEP", "CADILLAC", "GMC", "BUICK", "LINCOLN", "PONTIAC"]
#: Fuels that name a variant, and those that burn beside a motor (fixed values).
VARIANT_FUELS = ["ETHANOL", "LPG", "CNG", "HYBRID PETROL", "HYBRID DIESEL"]
COMBUSTION_FUELS = ["PETROL", "DIESEL", "HYBRID PETROL", "HYBRID DIESEL"]
VETERAN_BEFORE = 1975
ELECTRIC_SHARE = 0.02
#: Fields in which a conflict can't be outweighed (fixed values).
HARD_CONFLICTS = ["displacement_cc", "engine_code", "fuels", "manufacturer", "model_series", "power_kw", "year"]


def told(*cases: tuple[Column | bool, str, str, float | Column]) -> Column:
    """The first of (condition, name, state, effect) whose condition holds; the last one's holds by being True."""
    one = lambda name, state, effect: F.struct(F.lit(name).alias("name"), F.lit(state).alias("state"), (effect if isinstance(effect, Column) else F.lit(float(effect))).cast("double").alias("effect"))
    out = one(*cases[-1][1:])
    for condition, *rest in reversed(cases[:-1]):
        out = F.when(F.coalesce(condition, F.lit(False)), one(*rest)).otherwise(out)
    return out


def named(name: str, state: Column, match: float, near: float, conflict: float) -> Column:
    effect = F.when(state == "matched", match).when(state == "unverified", near).when(state == "conflicting", conflict).otherwise(0.0)
    return F.struct(F.lit(name).alias("name"), state.alias("state"), effect.alias("effect"))


def year_window(name: str, year: Column, first: Column, last: Column, outside: Column | None = None) -> Column:
    """A year in a window of which either end may be open (null); unverified where only the month lies outside, or the year is
    next to the window. Without any end it is missing."""
    gap, out = F.greatest(F.lit(0), first - year, year - last), F.lit(False) if outside is None else outside
    return told(
        (year.isNull(), name, "none", 0), (first.isNull() & last.isNull(), name, "missing", 0),
        ((gap == 0) & out, f"{name}_month_outside_unverified", "unverified", -0.05), (gap == 0, name, "matched", 0.05),
        (gap <= 1, f"{name}_adjacent_unverified", "unverified", -0.05), (True, name, "conflicting", -0.20),
    )


def displacement(name: str, query: Column, candidate: Column, rotary: Column) -> Column:
    """Equal, up to 3 apart (unverified), or a query of twice a rotary candidate, whose chambers count twice."""
    return told(
        (query.isNull(), name, "none", 0), (candidate.isNull(), name, "missing", 0), (query == candidate, name, "matched", 0.05),
        (F.abs(query - candidate) <= 3, f"{name}_rounding_unverified", "unverified", -0.05), (rotary & (query == 2 * candidate), name, "matched", 0.05),
        (True, name, "conflicting", -0.25),
    )


def unit_gap(a: Column, b: Column) -> Column:
    """One figure is the other in the other unit of horsepower, within two roundings."""
    return F.abs(F.greatest(a, b) - F.least(a, b) * F.lit(KW_PER_HP / KW_PER_PS)) <= UNIT_SLACK


def power(name: str, query: Column, candidate: Column, *, electric: Column, only_near: Column, hybrid: Column, units: Column, veteran: Column, equivalent: Column | None = None) -> Column:
    """Equal or reviewed as the same; else unverified in this order: up to 2 apart; both purely electric and the only figure
    of its model that near; below a hybrid's; two units of horsepower (units: a maker of UNIT_MAKERS without electricity);
    a veteran. Else a conflict."""
    near = lambda why: f"{name}_{why}_unverified"
    return told(
        (query.isNull(), name, "none", 0), (candidate.isNull(), name, "missing", 0), (query == candidate, name, "matched", 0.05),
        (F.lit(False) if equivalent is None else equivalent, name, "matched", 0.05), (F.abs(query - candidate) <= 2, name, "unverified", -0.05),
        (electric & only_near, near("electric"), "unverified", -0.05), (hybrid & (query < candidate), near("hybrid"), "unverified", -0.05),
        (units & unit_gap(query, candidate), near("horsepower_unit"), "unverified", -0.05), (veteran, near("veteran"), "unverified", -0.05),
        (True, name, "conflicting", -0.25),
    )


def neighbours(candidates: DataFrame, keys: Sequence[str], figure: str) -> DataFrame:
    """candidates with before_<figure> and after_<figure>: the next different figures of the same keys (null at an end).

    Figures near a query's, within a share of themselves, are neighbours of each other in order; so one figure is the only
    near one if these two aren't near, and no list of a model's figures has to travel with a pair.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy(figure)
    each = candidates.select(*keys, figure).where(F.col(figure).isNotNull()).distinct()
    each = each.withColumns({f"before_{figure}": F.lag(figure).over(order), f"after_{figure}": F.lead(figure).over(order)})
    same = [F.col(f"__c.{c}").eqNullSafe(F.col(f"__n.{c}")) for c in (*keys, figure)]
    joined = candidates.alias("__c").join(each.alias("__n"), reduce(lambda a, b: a & b, same), "left")
    return joined.select("__c.*", f"__n.before_{figure}", f"__n.after_{figure}")


def only_near(query: Column, candidate: Column, before: Column, after: Column, share: float = ELECTRIC_SHARE) -> Column:
    """Whether a candidate's figure is within a share of itself of the query's, and neither neighbour of it is."""
    near = lambda c: F.coalesce(F.abs(c - query) <= share * c, F.lit(False))
    return near(candidate) & ~near(before) & ~near(after)


def fuels_meet(query: Column, fuels: Column) -> Column:
    """A common fuel, or a hybrid candidate whose two parts the query names."""
    hybrid = lambda part: F.array_contains(fuels, f"HYBRID {part}") & F.array_contains(query, part) & F.array_contains(query, "ELECTRIC")
    return F.arrays_overlap(query, fuels) | hybrid("PETROL") | hybrid("DIESEL")


def fuels(name: str, query: Column, candidate: Column, components: Column, compatible: Sequence[tuple[str, str]] = ()) -> Column:
    """Sets of fuels: met; met in the base fuel alone where the query is a variant; compatible by reviewed (query, candidate)
    pairs or by the engine's components; else a conflict. Null sets are empty."""
    none = F.array().cast("array<string>")
    q, c, k = (F.coalesce(x, none) for x in (query, candidate, components))
    variants = F.array(*map(F.lit, VARIANT_FUELS))
    paired = lambda x: reduce(lambda a, b: a | b, (F.array_contains(q, a) & F.array_contains(x, b) for a, b in compatible), F.lit(False))
    shared = F.array_intersect(F.array_intersect(c, q), variants)
    other_variant = F.size(F.array_except(F.array_intersect(c, variants), q)) > 0
    return told(
        (F.size(q) == 0, name, "none", 0), ((F.size(c) == 0) & (F.size(k) == 0), name, "missing", 0),
        (fuels_meet(q, c) & (~F.arrays_overlap(q, variants) | (F.size(shared) > 0)), name, "matched", 0.05),
        (fuels_meet(q, c), f"{name}_variant_not_confirmed", "unverified", -0.05),
        (paired(c), f"{name}_compatible_not_confirmed", "unverified", F.when(other_variant, -0.05).otherwise(0.0)),
        (fuels_meet(q, k) | paired(k), f"{name}_compatible_not_confirmed", "unverified", 0), (True, name, "conflicting", -0.15),
    )


def engine(relation: Column) -> Column:
    """The evidence of a relation of engine codes (functions.engines.relation); null where the query has no code."""
    exact = [(relation == r, r, "matched", 0.12) for r in ("engine_code", "engine_code_alias", "engine_code_list")]
    return told((relation.isNull(), "engine_code", "none", 0), (relation == "missing", "engine_code", "missing", 0), *exact, (relation == "engine_code_family", "engine_code_family", "matched", 0.03), (relation == "engine_code_unverified", "engine_code_unverified", "unverified", 0), (True, "engine_code", "conflicting", -0.25))


def one_value(name: str, query: Column, candidates: Column, compatible: Sequence[tuple[str, str]] = (), near: float = 0.0) -> Column:
    """A query's value against a candidate's values (array): one of them, compatible by reviewed (query, candidate) pairs, or
    none of them."""
    c = F.coalesce(candidates, F.array().cast("array<string>"))
    paired = reduce(lambda a, b: a | b, ((query == a) & F.array_contains(c, b) for a, b in compatible), F.lit(False))
    return told(
        (query.isNull(), name, "none", 0), (F.size(c) == 0, name, "missing", 0), (F.array_contains(c, query), name, "matched", 0.05),
        (paired, f"{name}_compatible_not_confirmed", "unverified", near), (True, name, "conflicting", -0.15),
    )


def series(query: Column, label: Column) -> Column:
    """Groups of digits of two labels, in their order, are the same; where one has none nothing is compared."""
    a, b = (F.regexp_extract_all(x, F.lit("([0-9]+)")) for x in (query, label))
    return told(((F.size(a) > 0) & (F.size(b) > 0) & (a != b), "model_series", "conflicting", -0.35), (True, "model_series", "none", 0))


def reviewed(pairs: DataFrame, query: str, candidate: str, table: DataFrame, name: str, match: float, near: float, conflict: float) -> DataFrame:
    """pairs with an evidence column `name`: equal values match; for others a reviewed table (left_value, right_value, verdict
    equivalent or compatible) decides, in either direction. A null on either side is missing."""
    both = table.select(F.col("left_value").alias("__l"), F.col("right_value").alias("__r"), "verdict")
    both = both.unionByName(table.select(F.col("right_value").alias("__l"), F.col("left_value").alias("__r"), "verdict"))
    both = both.groupBy("__l", "__r").agg(F.max("verdict").alias("verdict"))
    joined = pairs.join(both, (F.col(query) == F.col("__l")) & (F.col(candidate) == F.col("__r")), "left")
    q, c, verdict = F.col(query), F.col(candidate), F.coalesce("verdict", F.lit(""))
    state = F.when(q.isNull() | c.isNull(), "missing").when((q == c) | (verdict == "equivalent"), "matched").when(verdict == "compatible", "unverified").otherwise("conflicting")
    return joined.withColumn(name, named(name, state, match, near, conflict)).drop("__l", "__r", "verdict")


def phonetic_bonus(text_score: Column, overlap: Column) -> Column:
    """Texts that sound alike gain 0.08 where their likeness is at least 0.35 and not whole."""
    return F.when(overlap & (text_score >= 0.35) & (text_score < 1), 0.08).otherwise(0.0)


def confidence(text: Column, scope: Column, context: Column, margin: Column) -> Column:
    """0.50 text + 0.20 scope + 0.20 context + 0.10 of the margin's share of what is asked; each part to 6 places."""
    signal = F.lit(0.0)
    for state, v in SCOPE_SIGNAL.items():
        signal = F.when(scope == state, v).otherwise(signal)
    parts = [0.50 * text, 0.20 * signal, 0.20 * context, 0.10 * F.least(F.lit(1.0), margin / MARGIN)]
    return F.round(sum((F.round(p, 6) for p in parts[1:]), F.round(parts[0], 6)), 6)


def gates(tests: Mapping[str, Column], unverified: Column, score: Column) -> Column:
    """The first gate that holds sends a pair to review under its name; then the score decides, and a pair that would be
    resolved is provisional where it is unverified."""
    held = F.lit(None).cast("string")
    for name, test in reversed(list(tests.items())):
        held = F.when(test, f"review:{name}").otherwise(held)
    decided = F.when((score >= RESOLVED) & ~F.coalesce(unverified, F.lit(False)), "resolved").when(score >= PROVISIONAL, "provisional").otherwise("review:score")
    return F.coalesce(held, decided)


def eligibility(tests: Mapping[str, Column]) -> Column:
    """All reasons that hold against a decision, in order; empty where it may stand."""
    return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in tests.items())), lambda x: x.isNotNull())
