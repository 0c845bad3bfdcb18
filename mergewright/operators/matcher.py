"""Records matched to a catalogue: pairs that labels and makers allow, all evidence in two passes, guards, one route each.

A record (columns q_id, q_maker, q_model, q_year, q_month, q_fuels, q_code, q_cc, q_kw, q_drive, q_body, q_plug) is matched to
types (c_id, c_maker, c_model, c_year_from, c_year_to, c_month_from, c_month_to, c_fuels, c_parts, c_codes, c_cc, c_kw, c_drive,
c_bodies, c_plug, c_rotary) through their labels (c_id, label: the model's name and its aliases). Makers, models and labels
are comparison texts; months are yyyymm; fuels, parts, codes and bodies are arrays. Any value may be null.

Pairs come from distinct (maker, model) of records: the label join of `similar` and the makers' scopes, so a maker is no
block by itself. A pair whose label scores below `bar` isn't looked at, whatever its other evidence.

The first pass scores every pair with months that demote other lines only and veterans' power unknown. What it finds
plausible decides the second: where a plausible type has a veteran's power, that counts after all; months demote within the
record's own line only where some line without a conflict was built in that month. Then guards look across a record's
candidates, and gates route it. Records of equal id are one record; without a candidate a record has a row with a null top.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import engines
from ..functions.text import phonetic_codes, tokens
from ..sources.shared import stored
from . import evidence as ev
from . import similar

PLUG_IN = ["plug_in_hybrid", "range_extender"]
#: Evidence that decides nothing by itself, and what has to stand beside it.
TOLERATED = ["power_kw_horsepower_unit_unverified", "displacement_cc_rounding_unverified"]
EXACT = ["power_kw", "displacement_cc", "engine_code", "engine_code_alias", "engine_code_list"]
#: The columns of evidence, in the order in which their effects are added and their names listed.
EVIDENCE = ["series", "fuels", "engine", "displacement", "drive", "body", "year", "power"]
#: Evidence that takes most time, and the most that it adds (fixed values).
COSTLY = {"fuels": 0.05, "engine": 0.12}


def pairs(records: DataFrame, types: DataFrame, labels: DataFrame, bar: float = similar.LABEL_BAR) -> DataFrame:
    """Records with the types that their model and maker allow: all columns of both, scope, text_score, matched_label,
    partial (the model's words are some of the label's), sound (what a common sound adds) and series (evidence of digits)."""
    heads = stored(records.select("q_maker", "q_model").distinct())
    scopes = similar.maker_scopes(heads, "q_maker", types, "c_maker")
    # What belongs to a model and a label is worked out there, once for all types of that label.
    words, of = tokens(F.col("a")), tokens(F.col("b"))
    overlap = F.arrays_overlap(phonetic_codes(F.col("a")), phonetic_codes(F.col("b")))
    scores = similar.label_scores(heads, "q_model", labels, "label", bar)
    scores = stored(scores.withColumns({"partial": (F.size(F.array_except(words, of)) == 0) & (F.size(words) < F.size(of)), "sound": ev.phonetic_bonus(F.col("text_score"), overlap), "series": ev.series(F.col("a"), F.col("b"))}))
    best = similar.best_labels(scores.select("a", "b", "text_score"), labels, "c_id", "label").join(types.select("c_id", "c_maker"), "c_id")
    best = best.join(scores.drop("text_score").withColumnRenamed("b", "matched_label"), ["a", "matched_label"])
    allowed = heads.join(scopes, "q_maker").join(best.withColumnRenamed("a", "q_model"), ["q_model", "c_maker"])
    # Evidence is taken where this join makes its pairs: records stay dealt over tasks there, and aren't broadcast to the few
    # tasks that hold what is allowed, as Spark would for a small table.
    return records.join(allowed.drop("c_maker").hint("merge"), ["q_maker", "q_model"]).join(types, "c_id")


def _outside(month: Column, first: Column, last: Column) -> Column:
    return F.coalesce(month < first, F.lit(False)) | F.coalesce(month > last, F.lit(False))


def _line(model: Column) -> Column:
    return F.split(model, " ")[0]


def _year(outside: Column) -> Column:
    return ev.year_window("year", F.col("q_year"), F.col("c_year_from"), F.col("c_year_to"), outside)


def _fuel_kinds(side: str) -> dict[str, Column]:
    """Whether any fuel of a side (q or c) is a hybrid, any is electric, and the only one is."""
    fuels = F.coalesce(F.col(f"{side}_fuels"), F.array().cast("array<string>"))
    some = lambda kind: F.exists(fuels, lambda x: x.startswith(kind))
    return {f"{side}_hybrid": some("HYBRID"), f"{side}_electric": some("ELECTRIC"), f"{side}_purely": F.coalesce(fuels == F.array(F.lit("ELECTRIC")), F.lit(False))}


def _power(veteran: Column) -> Column:
    hybrid, electric = F.col("q_hybrid") | F.col("c_hybrid"), F.col("q_electric") | F.col("c_electric")
    return ev.power(
        "power_kw", F.col("q_kw"), F.col("c_kw"), electric=F.col("q_purely") & F.col("c_purely"),
        only_near=ev.only_near(F.col("q_kw"), F.col("c_kw"), F.col("before_c_kw"), F.col("after_c_kw")), hybrid=hybrid,
        units=F.col("c_maker").isin(ev.UNIT_MAKERS) & ~(hybrid | electric), veteran=veteran,
    )


def _names(states: Sequence[str], evidence: str = "evidence") -> Column:
    return F.transform(F.filter(evidence, lambda e: e["state"].isin(*states)), lambda e: e["name"])


def _reaching(pairs: DataFrame, total: Column, bar: float) -> DataFrame:
    """The pairs with `separation`, where that (1 at most) reaches the bar.

    The optimizer puts what makes a column into a condition on it, and all evidence would be made twice or more often, for
    every pair. It doesn't where the column comes out of an array.
    """
    return pairs.withColumn("separation", F.explode(F.array(total))).where(F.least("separation", F.lit(1.0)) >= bar)


def _sum(evidence: Sequence[str]) -> Column:
    return F.col("text_score") + reduce(add, (F.col(e)["effect"] for e in evidence)) + F.col("sound")


def _plausible(pairs: DataFrame) -> DataFrame:
    return _reaching(pairs, F.round(_sum(EVIDENCE), 6), ev.PLAUSIBLE)


def scored(
    records: DataFrame, types: DataFrame, labels: DataFrame, bar: float = similar.LABEL_BAR, fuel_pairs: Sequence[tuple[str, str]] = (), drive_pairs: Sequence[tuple[str, str]] = (), body_pairs: Sequence[tuple[str, str]] = ()
) -> DataFrame:
    """The plausible pairs with separation (the score, unbounded), confidence (within 0 and 1), matched, missing and
    conflicting names, partial and phonetic."""
    # What belongs to one side is worked out there, once a record, code or type, and not for every pair.
    asked = engines.with_known(records.select("q_code").where("q_code IS NOT NULL").distinct(), "q_code", types, "c_codes")
    asked = stored(asked.withColumn("code", engines.described(F.col("q_code"))))
    known = stored(records.withColumns({**_fuel_kinds("q"), "q_line": _line(F.col("q_model"))}))
    whole = ev.neighbours(types, ["c_maker", "c_model"], "c_kw").withColumn("codes", engines.described_set(F.col("c_codes")))
    whole = stored(whole.withColumns({**_fuel_kinds("c"), "c_line": _line(F.col("c_model"))}))
    x = pairs(known.join(asked, "q_code", "left"), whole, labels, bar)
    out = _outside(F.col("q_month"), F.col("c_month_from"), F.col("c_month_to"))
    x = x.withColumns({"outside": out, "same_line": F.coalesce(F.col("c_line") == F.col("q_line"), F.lit(False))})
    old = F.coalesce(F.col("q_year") < ev.VETERAN_BEFORE, F.lit(False))
    x = x.withColumns({
        "displacement": ev.displacement("displacement_cc", F.col("q_cc"), F.col("c_cc"), F.coalesce(F.col("c_rotary"), F.lit(False))),
        "drive": ev.one_value("drive_type", F.col("q_drive"), F.when(F.col("c_drive").isNotNull(), F.array("c_drive")), drive_pairs), "body": ev.one_value("bodywork", F.col("q_body"), F.col("c_bodies"), body_pairs, -0.05),
        "year": _year(F.col("outside") & ~F.col("same_line")), "power": _power(old),
    })
    # Pairs that the most of the costly evidence wouldn't lift to the bar, roundings aside, are left before that is taken.
    x = _reaching(x, _sum([e for e in EVIDENCE if e not in COSTLY]) + sum(COSTLY.values()), ev.PLAUSIBLE - 1e-6)
    drivetrain = F.coalesce(F.col("c_plug").isin("battery_electric", "range_extender"), F.lit(False)) & ~F.coalesce(F.col("q_year").isNull() | (F.col("q_year") < F.col("c_year_from")) | (F.col("q_year") > F.col("c_year_to")), F.lit(False))
    relation = F.when(F.col("q_code").isNotNull(), engines.relation(F.col("code"), F.col("codes"), F.col("code_known"), drivetrain=drivetrain))
    first = _plausible(x.withColumn("relation", relation).withColumns({"fuels": ev.fuels("fuels", F.col("q_fuels"), F.col("c_fuels"), F.col("c_parts"), fuel_pairs), "engine": ev.engine(F.col("relation"))}))
    # A veteran's power counts where a plausible type has it.
    record = Window.partitionBy("q_id")
    told = F.col("c_kw").isNotNull() & (F.col("power.state") != "conflicting") & (F.col("power.name") != "power_kw_veteran_unverified")
    counts = F.coalesce(F.max(told).over(record), F.lit(False))
    again = _plausible(first.withColumn("counts", counts).withColumn("power", F.when(F.col("counts"), _power(F.lit(False))).otherwise(F.col("power"))))
    # Lines that were built in the record's month.
    clash = reduce(lambda a, b: a | b, (F.col(e)["state"] == "conflicting" for e in EVIDENCE))
    built = F.col("q_month").isNotNull() & ~clash & (F.col("c_month_from").isNotNull() | F.col("c_month_to").isNotNull()) & ~F.col("outside")
    again = again.withColumns({"clash": clash, "lines": F.collect_set(F.when(built, F.col("c_line"))).over(record)})
    demoted = F.col("outside") & (F.col("clash") | ~F.col("same_line") | F.array_contains("lines", F.col("c_line")))
    last = _plausible(again.withColumn("year", F.when(F.size("lines") > 0, _year(demoted)).otherwise(F.col("year")))).withColumn("evidence", F.array(*EVIDENCE))
    extra = lambda test, name: F.when(test, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    matched = F.concat(F.array(F.lit("model")), extra(F.col("partial"), "model_partial"), extra(F.col("sound") > 0, "model_phonetic"), _names(["matched"]))
    return last.select(
        "q_id", "c_id", "scope", "matched_label", "text_score", "separation", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("separation"))).alias("confidence"), matched.alias("matched"), _names(["missing", "unverified"]).alias("missing"), _names(["conflicting"]).alias("conflicting"),
        "partial", (F.col("sound") > 0).alias("phonetic"), "q_fuels", "q_plug", "c_plug",
    )


def ranked(candidates: DataFrame) -> DataFrame:
    """Candidates of each record in order of separation, then id, with rank, n_candidates and margin to the next one (the whole
    separation where there is none)."""
    order = Window.partitionBy("q_id").orderBy(F.desc("separation"), "c_id")
    after = F.lead("separation").over(order)
    return candidates.withColumns({"rank": F.row_number().over(order), "n_candidates": F.count("*").over(Window.partitionBy("q_id")), "margin": F.when(after.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), F.round(F.col("separation") - after, 6)))})


def _guards(order: DataFrame) -> DataFrame:
    """order with plug_in and rounding: guards that look at a record's first candidate beside its others.

    plug_in: only power parts the first one, known to be no plug-in, from a plug-in without conflicts that the record may be.
    rounding: the first one's displacement is only near, and another has it exactly with nothing but its engine code against it.
    """
    record = Window.partitionBy("q_id")
    has = lambda c, n: F.array_contains(F.col(c), n)
    top = F.struct("separation", "matched", "missing", "c_plug", "q_fuels", "q_plug", "margin", "n_candidates")
    x = order.withColumn("top", F.max(F.when(F.col("rank") == 1, top)).over(record))
    combustion = F.array(*map(F.lit, ev.COMBUSTION_FUELS))
    asked = (
        ~F.coalesce(F.col("top.q_plug") == "hybrid", F.lit(False)) & has("top.matched", "power_kw") & ~((F.col("top.n_candidates") > 1) & (F.col("top.margin") < ev.MARGIN))
        & F.coalesce(has("top.q_fuels", "ELECTRIC") & F.arrays_overlap("top.q_fuels", combustion), F.lit(False)) & F.col("top.c_plug").isNotNull() & ~F.col("top.c_plug").isin(PLUG_IN)
    )
    swing = F.when(has("top.matched", "displacement_cc") & has("missing", "displacement_cc_rounding_unverified"), 0.10).otherwise(0.0)
    gap = F.round(F.col("top.separation") - 0.05 - (F.col("separation") + 0.05) - swing, 6)
    rival = (F.col("rank") > 1) & (F.size("conflicting") == 0) & has("missing", "power_kw_hybrid_unverified") & F.coalesce(F.col("c_plug").isin(PLUG_IN), F.lit(False)) & (gap < ev.MARGIN)
    exact = (F.col("rank") > 1) & has("matched", "displacement_cc") & (F.col("conflicting") == F.array(F.lit("engine_code"))) & has("top.missing", "displacement_cc_rounding_unverified")
    return x.withColumns({"plug_in": F.bool_or(asked & rival).over(record), "rounding": F.bool_or(exact).over(record)})


def decided(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """One row a record: its first candidate, reason (why that may stand or not), confidence, route and route_reason.

    Gates in order: hard conflict, other conflict, scope of makers, partial label, sound, margin (also where a guard holds),
    then the bars; a record whose engine code nothing knows is provisional at best.
    """
    x = _guards(ranked(candidates)).where("rank = 1")
    has = lambda c, n: F.array_contains(F.col(c), n)
    close = (F.col("n_candidates") > 1) & (F.col("margin") < ev.MARGIN)
    tolerated = F.arrays_overlap("missing", F.array(*map(F.lit, TOLERATED))) & ~F.arrays_overlap("matched", F.array(*map(F.lit, EXACT)))
    reason = (
        F.when(F.size("conflicting") > 0, "context_conflict_requires_review").when(F.col("scope") != "exact_manufacturer", "manufacturer_scope_requires_review")
        .when(F.col("phonetic"), "phonetic_candidate_requires_review").when(F.col("partial"), "partial_model_requires_review").when(F.col("plug_in"), "candidate_margin_not_met")
        .when(F.col("confidence") < ev.RESOLVED, "automatic_threshold_not_met").when(close | F.col("rounding") | tolerated, "candidate_margin_not_met").otherwise("automatic_candidate_threshold_met")
    )
    observed = F.array_except("matched", F.array(F.lit("model"), F.lit("model_phonetic")))
    every = F.size(F.array_union(F.array_union(observed, "missing"), F.col("conflicting")))
    context = F.when(every > 0, (F.size(observed) + 0.5 * F.size(F.array_distinct("missing"))) / every).otherwise(0.5)
    x = x.withColumns({"reason": reason, "hard": F.array_sort(F.array_intersect("conflicting", F.array(*map(F.lit, ev.HARD_CONFLICTS)))), "routed": ev.confidence(F.col("text_score"), F.col("scope"), context, F.col("margin"))})
    gate = (
        F.when(F.size("hard") > 0, F.concat(F.lit("hard_conflict:"), F.array_join("hard", ","))).when(F.col("reason") == "context_conflict_requires_review", "non_hard_context_conflict")
        .when(F.col("scope") != "exact_manufacturer", "manufacturer_scope_not_exact").when(F.col("partial"), "partial_model_requires_review").when(F.col("phonetic"), "phonetic_evidence_requires_review")
        .when((F.col("reason") == "candidate_margin_not_met") | close, "candidate_margin_below_gate")
    )
    unverified = has("missing", "engine_code_unverified")
    why = F.coalesce(gate, F.when((F.col("routed") >= ev.RESOLVED) & unverified, "engine_code_unverified").when(F.col("routed") >= ev.RESOLVED, "resolved_threshold_met").when(F.col("routed") >= ev.PROVISIONAL, "provisional_threshold_met").otherwise("provisional_threshold_not_met"))
    route = F.when(gate.isNotNull() | (why == "provisional_threshold_not_met"), "review_required").when(why == "resolved_threshold_met", "resolved").otherwise("provisional")
    top = x.select("q_id", F.col("c_id").alias("top_reference"), "separation", "margin", "n_candidates", "reason", F.col("routed").alias("confidence"), route.alias("route"), why.alias("route_reason"))
    whole = records.select("q_id").distinct().join(top, "q_id", "left")
    return whole.withColumns({
        "n_candidates": F.coalesce("n_candidates", F.lit(0)).cast("long"), "reason": F.coalesce("reason", F.lit("no_candidate_above_threshold")), "confidence": F.coalesce("confidence", F.lit(0.0)),
        "route": F.coalesce("route", F.lit("review_required")), "route_reason": F.coalesce("route_reason", F.lit("no_candidate_above_threshold")),
    })
