"""Append-only records and versions: ledgers that accept a replay, chains with heads, sealed versions, job claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import exact_signature, fingerprint, signature


def event_id(*columns: str) -> Column:
    """The id that the same event gets each time."""
    return signature(*columns)


def append_once(ledger: DataFrame, events: DataFrame, key: str, content: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the ledger with new events, conflicts): an event whose id is there with equal content is a replay and adds
    nothing; one with other content is a conflict. Equal events of one batch are one."""
    mark = exact_signature(*content)
    new = events.groupBy(key).agg(F.min(F.struct(mark.alias("mark"), *content)).alias("e"), F.countDistinct(mark).alias("kinds"))
    had = ledger.select(key, mark.alias("old_mark"))
    joined = new.join(had, key, "left")
    wrong = (F.col("kinds") > 1) | (F.col("old_mark").isNotNull() & (F.col("old_mark") != F.col("e.mark")))
    fresh = joined.where(~wrong & F.col("old_mark").isNull()).select(key, *(F.col(f"e.{c}").alias(c) for c in content))
    return ledger.select(key, *content).unionByName(fresh), joined.where(wrong).select(key)


def chain_heads(links: DataFrame, chain: str, position: str, values: list[str]) -> DataFrame:
    """The last link of each chain, and how long the chain is."""
    return links.groupBy(chain).agg(F.max(F.struct(position, *values)).alias("h"), F.count("*").alias("links")).select(chain, F.col(f"h.{position}").alias(position), *(F.col(f"h.{v}").alias(v) for v in values), "links")


def sealed(version: DataFrame, columns: list[str]) -> DataFrame:
    """The fingerprint under which a version is sealed: importing equal content again changes nothing."""
    return fingerprint(version, columns)


def version_delta(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rules that a version adds, drops or changes."""
    a, b = (x.select(key, exact_signature(*columns).alias(n)) for x, n in ((old, "o"), (new, "n")))
    state = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "dropped").when(F.col("o") != F.col("n"), "changed")
    return a.join(b, key, "full_outer").select(key, state.alias("delta")).where("delta IS NOT NULL")


def claim(jobs: DataFrame, key: str) -> DataFrame:
    """What a claim of each job meets: run (new or failed), skip (completed) or refuse (running), by its latest state."""
    last = jobs.groupBy(key).agg(F.max(F.struct("attempt", "status")).alias("l"))
    answer = F.when(F.col("l.status") == "completed", "skip").when(F.col("l.status") == "running", "refuse").otherwise("run")
    return last.select(key, F.col("l.attempt").alias("attempt"), answer.alias("claim"))
