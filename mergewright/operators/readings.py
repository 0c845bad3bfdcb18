"""Records that may be read in several ways: distinct readings are evaluated once, and siblings guard the winner.

A reading is a row (key, position, and the columns that make it up). Equal readings of any records are one question (nulls
are values), so what an evaluation costs follows their number and not that of the records. Of a record's readings the one of
the best route wins, then of the highest confidence, then of the least position. Where the winner conflicts with the record
and a sibling of no worse route doesn't, that sibling (the first of them in the same order) takes its place. Guards then
compare the winner with each of its siblings: one that holds sends the record to review.

A reading that the evaluation has no row for is of the last route, with confidence 0; repeated readings of a record count as
they come; a record without siblings passes every guard but those that ask for one; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .latest import exact_signature

#: Routes from the best on; any other counts as the last (fixed values).
ROUTES = ["resolved", "provisional", "review_required"]


def decide(
    readings: DataFrame, key: str, reading: Sequence[str], evaluate: Callable[[DataFrame], DataFrame], guards: Mapping[str, tuple[str, Column]]
) -> DataFrame:
    """key, position, reference, route, confidence, replaced, held (names of guards that hold, in order) and n_readings of each
    record.

    evaluate: from distinct readings (reading_id and the reading's columns) to reading_id, reference, route, confidence and
    conflicts (boolean), one row each. guards: name to (any, all or none, a condition on w, the winner, and s, a sibling, both
    structs of position, reference, route, confidence and conflicts): it holds where any sibling satisfies it, where there are
    siblings and all do, or where none does.
    """
    if wrong := {q for q, _ in guards.values()} - {"any", "all", "none"}:
        raise ValueError(f"unknown quantifiers: {sorted(wrong)}")
    asked = readings.withColumn("reading_id", exact_signature(*reading))
    distinct = stored(asked.groupBy("reading_id").agg(*(F.first(c).alias(c) for c in reading)))
    answers = evaluate(distinct).select("reading_id", "reference", "route", "confidence", "conflicts")
    x = asked.select(key, "position", "reading_id").join(answers, "reading_id", "left")
    x = x.withColumns({"route": F.coalesce("route", F.lit(ROUTES[-1])), "confidence": F.coalesce("confidence", F.lit(0.0)), "conflicts": F.coalesce("conflicts", F.lit(False))})
    rank = F.lit(len(ROUTES) - 1)
    for i, r in enumerate(ROUTES[:-1]):
        rank = F.when(F.col("route") == r, i).otherwise(rank)
    record = Window.partitionBy(key)
    x = x.withColumn("__row", F.row_number().over(record.orderBy("position", "reading_id")))
    order = F.struct(rank.alias("rank"), (-F.col("confidence")).alias("c"), F.col("position"), F.col("__row"))
    each = x.withColumns({"__order": order, "s": F.struct("position", "reference", "route", "confidence", "conflicts")})
    each = each.withColumn("__first", F.min(F.struct("__order", "s")).over(record))
    clean = F.when(~F.col("conflicts") & (F.col("__order.rank") <= F.col("__first.__order.rank")), F.struct("__order", "s"))
    each = each.withColumn("__clean", F.min(clean).over(record))
    replaced = F.col("__first.s.conflicts") & F.col("__clean").isNotNull()
    each = each.withColumns({"__won": F.when(replaced, F.col("__clean")).otherwise(F.col("__first")), "replaced": replaced})
    each = each.withColumns({"w": F.col("__won.s"), "__other": F.col("__row") != F.col("__won.__order.__row")})
    counts = [F.count(F.when(F.col("__other") & F.coalesce(c, F.lit(False)), 1)).alias(f"__g{i}") for i, (_, c) in enumerate(guards.values())]
    one = each.groupBy(key).agg(F.first("w").alias("w"), F.first("replaced").alias("replaced"), F.count("*").alias("n_readings"), F.count(F.when(F.col("__other"), 1)).alias("__others"), *counts)
    test = {"any": lambda n: n > 0, "all": lambda n: (n > 0) & (n == F.col("__others")), "none": lambda n: n == 0}
    held = F.filter(F.array(*(F.when(test[q](F.col(f"__g{i}")), F.lit(name)) for i, (name, (q, _)) in enumerate(guards.items())), F.lit(None).cast("string")), lambda g: g.isNotNull())
    one = one.withColumn("held", held)
    route = F.when(F.size("held") > 0, "review_required").otherwise(F.col("w.route"))
    return one.select(key, F.col("w.position").alias("position"), F.col("w.reference").alias("reference"), route.alias("route"), F.col("w.confidence").alias("confidence"), "replaced", "held", "n_readings")
