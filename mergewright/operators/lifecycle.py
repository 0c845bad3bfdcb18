"""Rules, observations, reviews and versions over time: what is kept, retired, cleared, confirmed, refused or stale.

Where a docstring says nothing else: a null key meets nothing in a join and is a group of its own in an aggregate, repeated
rows count as they come, and empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import exact_signature, exact_text, latest_n


def reconcile(active: DataFrame, wanted: DataFrame, content: Sequence[str]) -> DataFrame:
    """What becomes of each rule: kept, retired or added. A rule's id is a hash of its content in which a null is a value of
    its own, so an equal rule is the same; repeated rules are one."""
    rule_id = exact_signature(*content).alias("rule_id")
    a, b = (x.groupBy(rule_id).agg(*(F.first(c).alias(c) for c in content)).withColumn(n, F.lit(True)) for x, n in ((active, "__active"), (wanted, "__wanted")))
    b = b.select("rule_id", *(F.col(c).alias(f"__of_{c}") for c in content), "__wanted")
    verdict = F.when(F.col("__active").isNull(), "add").when(F.col("__wanted").isNull(), "retire").otherwise("keep")
    return a.join(b, "rule_id", "full_outer").select("rule_id", *(F.when(F.col("__active"), F.col(c)).otherwise(F.col(f"__of_{c}")).alias(c) for c in content), verdict.alias("verdict"))


def validated_patterns(rows: DataFrame, keys: Sequence[str], value: str, agreement: float, support: int) -> DataFrame:
    """Patterns (keys -> most frequent value, ties to the least) whose siblings of another value stay within a tolerance of
    max(1, floor((1 - agreement) * siblings)), with at least `support` siblings."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = counted.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b"), F.sum("n").alias("siblings"))
    tolerance = F.greatest(F.lit(1), F.floor(F.round((1 - agreement) * F.col("siblings"), 6)))
    out = best.select(*keys, F.col("b.v").alias(value), "siblings", (F.col("siblings") + F.col("b.m")).alias("others"), tolerance.alias("tolerance"))
    return out.where((F.col("siblings") >= support) & (F.col("others") <= F.col("tolerance")))


def apply_implied(rows: DataFrame, rules: DataFrame, key: str, field: str, implied: Sequence[str]) -> DataFrame:
    """Fill an empty field from its rule, and with it the empty ones of the implied fields; filled names what was filled.

    rules: key, field and implied, one row for each key.
    """
    side = rules.select(key, *(F.col(c).alias(f"__{c}") for c in (field, *implied)))
    joined = rows.join(side, key, "left")
    fill = F.col(field).isNull() & F.col(f"__{field}").isNotNull()
    names = F.filter(F.array(*(F.when(fill & F.col(c).isNull() & F.col(f"__{c}").isNotNull(), F.lit(c)) for c in (field, *implied))), lambda x: x.isNotNull())
    values = {c: F.when(fill, F.coalesce(c, f"__{c}")).otherwise(F.col(c)) for c in (field, *implied)}
    kept = [c for c in rows.columns if c not in values]
    return joined.select(*kept, *(v.alias(c) for c, v in values.items()), F.array_join(names, ",").alias("filled"))


def apply_guarded(rows: DataFrame, rules: DataFrame, key: str, field: str, guard: Mapping[str, Column]) -> DataFrame:
    """Each proposed fill with its verdict: the first guard that refuses it, or filled; rows without a gap or rule are left."""
    proposed = rows.join(rules.select(key, F.col(field).alias("proposed")), key)
    verdict = F.coalesce(F.when(F.col(field).isNotNull(), "not_a_gap"), *(F.when(c, F.lit(f"refused:{n}")) for n, c in guard.items()), F.lit("filled"))
    return proposed.withColumn("verdict", verdict).where("verdict <> 'not_a_gap'")


def fold_in_time(observations: DataFrame, ranks: Mapping[str, int]) -> DataFrame:
    """The value of each (entity, field) after its observations (entity, field, value, source, observed_on, cleared) in order of
    observed_on, then source and value.

    - A value fills an empty field, and takes the place of one of lower rank, of its own source, or of equal rank and an
      earlier day; the source displaced is kept as an alternative, one a source. Otherwise it is kept beside as one.
    - The value that stands said again by another source changes nothing, not even its source and day.
    - Silence (null, not cleared) of the source that gave the value lets the best alternative speak, or empties the field; of
      another source it drops what that kept.
    - An explicit clear that would win empties the field, and an empty field is filled by whatever comes next.

    Ranks: by source, 0 for others. Rows are sorted within partitions by entity and field and folded as they come, so an
    entity of any length takes the memory of its sources. Null days come first; equal rows count each.
    """
    order = ["entity", "field", "observed_on", "source", "value", "cleared"]
    rows = observations.select("entity", "field", "value", "source", F.col("observed_on").cast("date").alias("observed_on"), F.coalesce("cleared", F.lit(False)).alias("cleared"))
    entity, field = observations.schema["entity"].dataType.simpleString(), observations.schema["field"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, n = None, None, 0

        def told() -> tuple:
            return (*key, *(state.now or (None, None, None)), len(state.others), n)

        names = ("entity", "field", "value", "source", "since", "n_alternatives", "n_observations")
        for b in batches:
            out = []
            for e, f, value, source, day, cleared in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (e, f) != key:
                    if key is not None:
                        out.append(told())
                    key, state, n = (e, f), _Field(ranks), 0
                state.observe(None if cleared else value, source, day, cleared)
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(names), kinds(b), strict=True)], names=names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(told(), kinds(b), strict=True)], names=names)

    def kinds(b: pa.RecordBatch) -> list[pa.DataType]:
        return [b.column(0).type, b.column(1).type, pa.string(), pa.string(), pa.date32(), pa.int64(), pa.int64()]

    folded = rows.repartition("entity", "field").sortWithinPartitions(*order)
    return folded.select("entity", "field", F.col("value").cast("string").alias("value"), "source", "observed_on", "cleared").mapInArrow(run, f"entity {entity}, field {field}, value string, source string, since date, n_alternatives long, n_observations long")


class _Field:
    """One field's value (value, source, day), and what other sources say, by source."""

    def __init__(self, ranks: Mapping[str, int]):
        self.ranks, self.now, self.others = ranks, None, {}

    def _wins(self, a: tuple, b: tuple) -> bool:
        """Whether a later statement a takes the place of b."""
        ra, rb = (self.ranks.get(x[1], 0) for x in (a, b))
        return ra > rb if ra != rb else a[1] == b[1] or (a[2] or date.min) > (b[2] or date.min)

    def observe(self, value, source: str, day, cleared: bool) -> None:
        said, now = (value, source, day), self.now
        if value is None and not cleared:
            self.others.pop(source, None)
            if now and now[1] == source:
                best = None
                for other in self.others.values():
                    best = other if best is None or self._wins(other, best) else best
                self.now = self.others.pop(best[1]) if best else None
        elif now is None:
            if value is not None:
                self.others.pop(source, None)
                self.now = said
        elif value == now[0]:
            self.others.pop(source, None)
        elif self._wins(said, now):
            if now[1] != source:
                self.others[now[1]] = now
            self.others.pop(source, None)
            self.now = None if value is None else said
        elif value is None:
            self.others.pop(source, None)
        else:
            self.others[source] = said


def project_corrections(merged: DataFrame, corrections: DataFrame, alternatives: DataFrame) -> DataFrame:
    """merged (entity, field, value, source) under the head of each (entity, field)'s corrections (entity, field, action, value,
    position): a set overrides; an ignore or withdraw takes a set that it supersedes back off, so that the best alternative
    (entity, field, value, source, one row each) speaks again, and otherwise leaves the field as it is.

    The head is the correction of the greatest position, what it supersedes the one before; a null action does nothing.
    """
    two = latest_n(corrections, ["entity", "field"], [F.desc("position"), "action", "value"], 2)
    at = lambda rank, c: F.max(F.when(F.col("rank") == rank, F.col(c)))
    last = two.groupBy("entity", "field").agg(at(1, "action").alias("__action"), at(1, "value").alias("__set"), at(2, "action").alias("__before"))
    other = alternatives.select("entity", "field", F.col("value").alias("__value"), F.col("source").alias("__source"))
    x = merged.join(last, ["entity", "field"], "left").join(other, ["entity", "field"], "left")
    off = F.col("__action").isin("ignore", "withdraw") & (F.col("__before") == "set")
    value = F.when(F.col("__action") == "set", F.col("__set")).when(off, F.col("__value")).otherwise(F.col("value"))
    source = F.when(F.col("__action") == "set", "correction").when(off, F.col("__source")).otherwise(F.col("source"))
    return x.select("entity", "field", value.alias("value"), source.alias("source"), F.coalesce("__action", F.lit("none")).alias("action"))


def freshness(promoted: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """How promoted links stand against current decisions (key, value, terminal): fresh, stale_terminal, cardinality (more than
    one current value), mismatch or unknown; with a count each."""
    now = current.groupBy(key).agg(F.countDistinct(value).alias("kinds"), F.min(value).alias("now"), F.max(F.col("terminal").cast("int")).alias("ended"))
    x = promoted.join(now, key, "left")
    state = F.when(F.col("kinds").isNull(), "unknown").when(F.col("ended") == 1, "stale_terminal").when(F.col("kinds") > 1, "cardinality").when(F.col("now").eqNullSafe(F.col(value)), "fresh").otherwise("mismatch")
    return x.groupBy(state.alias("freshness")).agg(F.count("*").alias("n"))


#: From each state of a review where it may go (fixed values).
TRANSITIONS = {"pending": ("in_review", "resolved", "rejected"), "in_review": ("pending", "resolved", "rejected"), "resolved": (), "rejected": ()}


def transitions(items: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Each request (key, to_state) against the item's state: moved, unchanged (already there), refused, or missing."""
    allowed = F.array(*(F.lit(f"{a}>{b}") for a, bs in TRANSITIONS.items() for b in bs))
    x = requests.join(items.select(key, F.col("state").alias("from_state")), key, "left")
    step = F.concat_ws(">", "from_state", "to_state")
    verdict = F.when(F.col("from_state").isNull(), "missing").when(F.col("from_state") == F.col("to_state"), "unchanged").when(F.array_contains(allowed, step), "moved").otherwise("refused")
    return x.select(key, "from_state", "to_state", verdict.alias("verdict"), F.when(verdict == "moved", F.col("to_state")).otherwise(F.col("from_state")).alias("state"))


def enqueue(queue: DataFrame, found: DataFrame, key: Sequence[str]) -> DataFrame:
    """The queue (key, state) with what was found and isn't in it yet, as pending; what is found again, a null key too, changes
    nothing."""
    had = queue.select(exact_signature(*key).alias("__had")).distinct()
    fresh = found.select(*key).distinct().withColumn("__key", exact_signature(*key)).join(had, F.col("__key") == F.col("__had"), "left_anti")
    return queue.select(*key, "state").unionByName(fresh.select(*key, F.lit("pending").alias("state")))


def sealed(versions: DataFrame, imports: DataFrame, version: str, content: Sequence[str]) -> DataFrame:
    """Each imported version against the sealed ones, by an order-free fingerprint of its rows (their number and the sums of
    both halves of each row's md5; null, empty text and the places of separators all count): sealed (new), replay or conflict."""
    row = F.md5(exact_text(*content))
    halves = [F.sum(F.conv(F.substring(row, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")).alias(f"h{i}") for i in range(2)]
    a, b = (x.groupBy(version).agg(F.count("*").alias("n_rows"), *halves) for x in (versions, imports))
    old = a.select(F.col(version).alias("__version"), *(F.col(c).alias(f"old_{c}") for c in ("n_rows", "h0", "h1")))
    x = b.join(old, F.col(version).eqNullSafe(F.col("__version")), "left")
    equal = (F.col("n_rows") == F.col("old_n_rows")) & (F.col("h0") == F.col("old_h0")) & (F.col("h1") == F.col("old_h1"))
    return x.select(version, "n_rows", F.when(F.col("old_n_rows").isNull(), "sealed").when(equal, "replay").otherwise("conflict").alias("verdict"))
