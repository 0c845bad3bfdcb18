"""Before and after, waterfalls, calibration and cohorts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .latest import exact_signature


def impact(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's change of a resolution: gained, lost, moved, same, or open on both sides."""
    a, b = (x.select(key, F.col(value).alias(n)) for x, n in ((before, "old_value"), (after, "new_value")))
    old, new = F.col("old_value"), F.col("new_value")
    change = F.when(old.isNull() & new.isNull(), "open").when(old.isNull(), "gained").when(new.isNull(), "lost").when(old != new, "moved").otherwise("same")
    return a.join(b, key, "full_outer").withColumn("change", change)


def transitions(changed: DataFrame, old: str, new: str) -> DataFrame:
    return changed.groupBy(F.coalesce(old, F.lit("-")).alias("before_state"), F.coalesce(new, F.lit("-")).alias("after_state")).agg(F.count("*").alias("n"))


def waterfall(df: DataFrame, reasons: Mapping[str, Column]) -> DataFrame:
    """How many rows each reason excludes when they are asked in order; the rest is eligible."""
    first = F.coalesce(*(F.when(c, F.lit(n)) for n, c in reasons.items()), F.lit("eligible"))
    return df.groupBy(first.alias("outcome")).agg(F.count("*").alias("n"))


def wilson(positive: Column, n: Column, z: float = 1.96) -> Column:
    """The lower bound of a share's interval; 0 without rows."""
    p = positive / n
    bound = (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    return F.when(n > 0, bound).otherwise(0.0)


def _running(per: DataFrame, order: str, sums: Sequence[str]) -> DataFrame:
    """per (a row for each value of `order`) with run_<c>, the sum of each column over this value and all above, and all_<c>.

    Running sums are taken within ranges of the values and then over the ranges, which quantiles of the values cut, so no
    task holds all of them whatever their scale.
    """
    cuts = sorted(set(per.select(F.col(order).cast("double").alias("t")).approxQuantile("t", [i / 64 for i in range(1, 64)], 0.005)))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x <= F.col(order))) if cuts else F.lit(0)
    ranged = per.withColumn("part", part)
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(*(F.sum(c).alias(f"part_{c}") for c in sums))
    carried = totals.select("part", *(F.coalesce(F.sum(f"part_{c}").over(above), F.lit(0)).alias(f"above_{c}") for c in sums))
    whole = totals.agg(*(F.sum(f"part_{c}").alias(f"all_{c}") for c in sums))
    inside = Window.partitionBy("part").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    x = ranged.withColumns({f"in_{c}": F.sum(c).over(inside) for c in sums}).join(carried, "part").join(F.broadcast(whole))
    return x.select(*per.columns, *((F.col(f"in_{c}") + F.col(f"above_{c}")).alias(f"run_{c}") for c in sums), *(f"all_{c}" for c in sums))


def sweep(df: DataFrame, score: str, good: str) -> DataFrame:
    """At each score as a threshold: rows at or above it, precision, recall and the precision's lower bound."""
    per = df.groupBy(F.col(score).alias("threshold")).agg(F.count("*").alias("n"), F.sum(F.col(good).cast("long")).alias("k"))
    n, k = F.col("run_n"), F.col("run_k")
    x = _running(per, "threshold", ["n", "k"])
    return x.select("threshold", n.alias("n_selected"), F.round(k / n, 6).alias("precision"), F.round(k / F.col("all_k"), 6).alias("recall"), F.round(wilson(k, n), 6).alias("precision_low"))


def weighted_sweep(df: DataFrame, score: str, good: str, weight: str, least: float = 30.0) -> DataFrame:
    """As sweep(), where a row counts by its weight: weighted precision and recall, the effective sample size (Kish: the square of
    the weights' sum over the sum of their squares), the lower bound of the precision for so many rows, and whether they are
    `least` at least. Rows whose score, weight or label is null, or whose weight isn't above 0, count nowhere."""
    w = F.col(weight).cast("double")
    known = df.where(F.col(score).isNotNull() & F.col(good).isNotNull() & (w > 0))
    per = known.groupBy(F.col(score).alias("threshold")).agg(F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * w).alias("w2"), F.sum(w * F.col(good).cast("int")).alias("k"))
    x = _running(per, "threshold", ["n", "w", "w2", "k"])
    precision, effective = F.col("run_k") / F.col("run_w"), F.col("run_w") * F.col("run_w") / F.col("run_w2")
    recall = F.when(F.col("all_k") > 0, F.col("run_k") / F.col("all_k")).otherwise(0.0)
    return x.select(
        "threshold", F.col("run_n").alias("n_selected"), F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(effective, 6).alias("effective"), F.round(wilson(precision * effective, effective), 6).alias("precision_low"),
        (F.round(effective, 6) >= least).alias("decidable"),
    )


def cohorts(df: DataFrame, signature: Sequence[str], reason: Column) -> DataFrame:
    """Rows with equal signatures are one cohort, named by a hash; with its size and counts by reason as text."""
    key = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in signature)), 256)
    counted = df.groupBy(key.alias("cohort"), *signature, reason.alias("reason")).agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.concat_ws("=", "reason", F.col("n").cast("string"))))
    return counted.groupBy("cohort", *signature).agg(F.sum("n").alias("members"), F.concat_ws(",", parts).alias("reasons"))


def changed_inputs(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys of new whose content differs from old's or that old doesn't have, by a hash of the columns."""
    digest = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)
    a, b = old.select(key, digest.alias("old_hash")), new.select(key, digest.alias("new_hash"))
    return b.join(a, key, "left").where(~F.col("old_hash").eqNullSafe(F.col("new_hash"))).select(key, F.when(F.col("old_hash").isNull(), "new").otherwise("changed").alias("kind"))


def leakage_components(tokens: DataFrame, node: str, token: str, store) -> DataFrame:
    """(node, component) of nodes that share tokens, directly or over others: the component is its least node.

    A token links its nodes to the least of them, so a frequent token costs its rows and never pairs. Labels fall along
    the links, and to their labels' labels, until nothing changes; `store` cuts the lineage of each round. Joins are by
    shuffle at any size: their tables grow with the nodes, and a broadcast each round would pass through the driver.
    """
    least = tokens.groupBy(token).agg(F.min(node).alias("b"))
    links = tokens.join(least.hint("merge"), token).select(F.col(node).alias("a"), "b").distinct()
    edges = store(links.union(links.select("b", "a")).distinct())
    labels = store(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(near.hint("merge"), "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("jumped"))
        new = store(low.join(jump.hint("merge"), "low").select("node", "old", F.least("low", "jumped").alias("component")))
        labels = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            return labels.withColumnRenamed("node", node)


def projected_proposals(known: DataFrame, unknown: DataFrame, key: str, profiles: Sequence[Sequence[str]], value: str, support: int = 2) -> DataFrame:
    """What value the rows of `unknown` (by key) have where rows of `known` look like them: by several projections, from the
    narrowest (most fields) to the widest, each a part of the first.

    A combination of a projection's fields proposes the one value that its rows have, if they are `support` at least; two
    values propose nothing. All projections are counted in one pass (grouping sets), and the first in the list that proposes
    wins. A combination with a null in any of its fields proposes and finds nothing. Returns key, value, profile (its place),
    n_support; rows without a proposal are left out.
    """
    fields = list(profiles[0])
    if any(set(p) - set(fields) for p in profiles) or len({tuple(sorted(p)) for p in profiles}) < len(profiles):
        raise ValueError("each projection has to be another part of the first")
    counted = known.where(F.col(value).isNotNull()).groupingSets([[F.col(f) for f in p] for p in profiles], *(F.col(f) for f in fields))
    counted = counted.agg(F.grouping_id(*fields).alias("__set"), F.count("*").alias("n_support"), F.min(value).alias("least"), F.max(value).alias("most"))
    sets = [sum(1 << (len(fields) - 1 - i) for i, f in enumerate(fields) if f not in p) for p in profiles]
    told = counted.where((F.col("least") == F.col("most")) & (F.col("n_support") >= support))
    mark = lambda p, i: F.when(reduce(and_, (F.col(f).isNotNull() for f in p)), F.struct(F.lit(i).alias("profile"), exact_signature(*p).alias("mark")))
    of_set = F.coalesce(*(F.when(F.col("__set") == s, mark(p, i)) for i, (s, p) in enumerate(zip(sets, profiles, strict=True))))
    proposals = told.select(of_set.alias("p"), F.col("least").alias("value"), "n_support").where("p IS NOT NULL").select("p.*", "value", "n_support")
    each = unknown.select(key, F.explode(F.array(*(mark(p, i) for i, p in enumerate(profiles)))).alias("p")).where("p IS NOT NULL").select(key, "p.*").distinct()
    # By shuffle at any size: proposals grow with the rows, and a broadcast would pass through the driver.
    first = each.join(proposals.hint("merge"), ["profile", "mark"]).groupBy(key).agg(F.min(F.struct("profile", "value", "n_support")).alias("b"))
    return first.select(key, F.col("b.value").alias(value), F.col("b.profile").alias("profile"), F.col("b.n_support").alias("n_support"))


def scoped_comparison(pairs: DataFrame, source: str, targets: str, rules: DataFrame, scopes: Sequence[Sequence[str]]) -> DataFrame:
    """pairs with state and rule_ids: how a source value stands to a candidate's values (an array), by rules of several scopes.

    rules: rule_id, value (the source's), allowed (an array) and the columns of all scopes; a rule's scope is the one whose
    columns it fills, the others null. A value among the candidate's is equivalent, whatever rules say. Else the first scope in
    the list with a rule for the pair decides: rules of it that allow different sets disagree, which is a conflict and never
    their union; one set is compatible where it has a value of the candidate's, conflicting where not, and unknown without
    any. Without a rule two values conflict, and a missing one is unknown. One equi join for each scope, with rules that are
    summed up by key before.
    """
    every = sorted({c for s in scopes for c in s})
    allowed = F.array_sort(F.array_distinct(F.coalesce("allowed", F.array().cast("array<string>"))))
    out, hits = pairs, []
    for i, scope in enumerate(scopes):
        own = reduce(and_, (F.col(c).isNotNull() if c in scope else F.col(c).isNull() for c in every), F.col("value").isNotNull())
        summed = rules.where(own).groupBy("value", *scope).agg(F.min(allowed).alias("a"), F.max(allowed).alias("b"), F.array_sort(F.collect_set("rule_id")).alias("ids"))
        named = summed.select(*(F.col(c).alias(f"__{i}_{c}") for c in ("value", *scope)), F.struct("a", "b", "ids").alias(f"__hit{i}"))
        on = [F.col(source) == F.col(f"__{i}_value"), *(F.col(c) == F.col(f"__{i}_{c}") for c in scope)]
        out = out.join(named, on, "left").drop(*(f"__{i}_{c}" for c in ("value", *scope)))
        hits.append(f"__hit{i}")
    have = F.filter(F.coalesce(targets, F.array().cast("array<string>")), lambda x: x.isNotNull())
    hit = F.coalesce(*hits)
    equal = F.coalesce(F.array_contains(have, F.col(source)), F.lit(False))
    by_rule = F.when(~hit["a"].eqNullSafe(hit["b"]), "conflicting").when(F.size(have) == 0, "unknown").when(F.arrays_overlap(hit["a"], have), "compatible").otherwise("conflicting")
    state = F.when(equal, "equivalent").when(hit.isNotNull(), by_rule).when(F.col(source).isNull() | (F.size(have) == 0), "unknown").otherwise("conflicting")
    ids = F.when(~equal & hit.isNotNull(), hit["ids"]).otherwise(F.array().cast("array<string>"))
    return out.select(*pairs.columns, state.alias("state"), ids.alias("rule_ids"))
