"""An ordered pipeline of normalisation stages over columns, with candidates, reasons, rule ids, a status and a trace.

The state of a row is three columns: a map of settled fields, a map of candidates, and an array of review reasons, beside
the ids of the rules that fired. A stage is a function of the row's columns that returns a Proposal of column
expressions; rules are rows of small tables that stages join. Everything is projections and joins of the table with its
rules: no stage looks at another row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATE = ("normalized", "candidates", "reasons", "rule_ids")
CONFIDENCE = {"review": 0.55, "provisional": 0.80, "resolved": 0.95, "failed": 0.0}


@dataclass(frozen=True)
class Proposal:
    """What a stage says about one field; nulls say nothing. A reason keeps the row for review."""

    field: str
    value: Column | None = None
    candidate: Column | None = None
    reason: Column | None = None
    rule_id: Column | None = None


Stage = tuple[str, Callable[[DataFrame], tuple[DataFrame, Sequence[Proposal]]]]


def start(df: DataFrame) -> DataFrame:
    """df with an empty state."""
    empty = F.create_map().cast("map<string,string>")
    none = F.array().cast("array<string>")
    return df.withColumns({"normalized": empty, "candidates": empty, "reasons": none, "rule_ids": none, "trace": F.array().cast("array<struct<stage:string,field:string,before:string,after:string>>")})


def run(df: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """The stages in order, then status and confidence; a field that is settled stays settled."""
    out = start(df)
    for name, stage in stages:
        columns = out.columns
        joined, proposals = stage(out)
        for p in proposals:
            joined = _apply(joined, name, p)
        out = joined.select(*columns)
    status = F.when(F.size("reasons") > 0, "review").when(F.size("candidates") > 0, "provisional").otherwise("resolved")
    confidence = F.create_map(*(x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.lit(v))))
    return out.withColumn("status", status).withColumn("confidence", confidence[F.col("status")])


def _apply(df: DataFrame, stage: str, p: Proposal) -> DataFrame:
    text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    before = F.try_element_at("normalized", F.lit(p.field))
    value = F.when(before.isNull(), text(p.value))
    put = lambda m, v: F.when(v.isNotNull(), F.map_concat(m, F.create_map(F.lit(p.field), v))).otherwise(F.col(m))
    candidate = F.when(before.isNull() & value.isNull() & F.try_element_at("candidates", F.lit(p.field)).isNull(), text(p.candidate))
    add = lambda a, v: F.when(v.isNotNull() & ~F.array_contains(a, F.coalesce(v, F.lit(""))), F.concat(a, F.array(v))).otherwise(F.col(a))
    fired = F.when(value.isNotNull() | candidate.isNotNull(), text(p.rule_id))
    entry = F.struct(F.lit(stage).alias("stage"), F.lit(p.field).alias("field"), before.alias("before"), value.alias("after"))
    return df.withColumns({"__v": value, "__c": candidate, "__r": text(p.reason), "__f": fired, "__t": entry}).withColumns(
        {
            "normalized": put("normalized", F.col("__v")),
            "candidates": put("candidates", F.col("__c")),
            "reasons": add("reasons", F.col("__r")),
            "rule_ids": add("rule_ids", F.col("__f")),
            "trace": F.when(F.col("__v").isNotNull(), F.concat("trace", F.array("__t"))).otherwise(F.col("trace")),
        }
    ).drop("__v", "__c", "__r", "__f", "__t")


def dictionary(df: DataFrame, column: str, rules: DataFrame, scope: Column | None = None) -> DataFrame:
    """df with rule_id and value of the rule whose term equals the column (in any case); rules: term, value, rule_id.

    Equal terms with different values are no answer. A scope column of the rules must equal `scope` or be null.
    """
    own = rules.withColumn("__term", F.lower("term"))
    if scope is None:
        unique = own.groupBy("__term").agg(F.when(F.countDistinct("value") == 1, F.min("value")).alias("__value"), F.min("rule_id").alias("__rule"))
        return df.withColumn("__term", F.lower(F.trim(column))).join(unique, "__term", "left").withColumnsRenamed({"__value": "rule_value", "__rule": "hit_rule"}).drop("__term")
    unique = own.groupBy("__term", "scope").agg(F.when(F.countDistinct("value") == 1, F.min("value")).alias("__value"), F.min("rule_id").alias("__rule"))
    scoped = unique.where("scope IS NOT NULL").withColumnRenamed("scope", "__scope")
    general = unique.where("scope IS NULL").select("__term", F.col("__value").alias("__gvalue"), F.col("__rule").alias("__grule"))
    x = df.withColumns({"__term": F.lower(F.trim(column)), "__scope": scope}).join(scoped, ["__term", "__scope"], "left").join(general, "__term", "left")
    return x.withColumns({"rule_value": F.coalesce("__value", "__gvalue"), "hit_rule": F.when(F.col("__value").isNotNull(), F.col("__rule")).otherwise(F.col("__grule"))}).drop("__term", "__scope", "__value", "__rule", "__gvalue", "__grule")


def whole_words(df: DataFrame, key: Sequence[str], column: str, rules: DataFrame) -> DataFrame:
    """df with the value of the longest term that occurs in the column as whole words; rules: term, value, rule_id.

    Texts are exploded to runs of words as long as the longest term, which meet the terms by an equi join; of equally long
    terms with different values none wins.
    """
    longest = rules.select(F.max(F.size(F.split("term", " "))).alias("n")).first().n or 0
    words = F.filter(F.split(F.lower(F.regexp_replace(column, r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")
    x = df.select(*key, words.alias("__w"))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(max(longest, 1))), lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size("__w"), F.lit(1))), lambda i: i + n - 1 <= F.size("__w")), lambda i: F.array_join(F.slice("__w", i, n), " "))))
    hits = x.select(*key, F.explode(F.array_distinct(runs)).alias("__term")).join(rules.select(F.lower("term").alias("__term"), "value", "rule_id"), "__term")
    top = F.max(F.length("__term")).over(Window.partitionBy(*key))
    best = hits.withColumn("__top", top).where(F.length("__term") == F.col("__top"))
    one = best.groupBy(*key).agg(F.when(F.countDistinct("value") == 1, F.min("value")).alias("rule_value"), F.when(F.countDistinct("value") == 1, F.min("rule_id")).alias("hit_rule"))
    return df.join(one, list(key), "left")


def policies(df: DataFrame, rules: Sequence[tuple[str, Mapping[str, str], Mapping[str, str | None]]]) -> DataFrame:
    """The first policy, by its key, all of whose columns match sets or clears fields and empties the reasons."""
    out = df
    done = F.lit(False)
    for key, match, changes in sorted(rules, key=lambda r: r[0]):
        hit = F.lit(True)
        for c, v in match.items():
            hit = hit & F.coalesce(F.col(c).cast("string") == v, F.lit(False))
        hit = hit & ~done
        out = out.withColumn(f"__p_{key}", hit)
        done = done | F.col(f"__p_{key}")
        now = F.col(f"__p_{key}")
        gone = [f for f, v in changes.items()]
        kept = F.map_filter("normalized", lambda k, _: ~k.isin(*gone))
        new = [(f, v) for f, v in changes.items() if v is not None]
        changed = F.map_concat(kept, F.create_map(*(F.lit(x) for f, v in new for x in (f, v)))) if new else kept
        out = out.withColumns({"normalized": F.when(now, changed).otherwise(F.col("normalized")), "reasons": F.when(now, F.array().cast("array<string>")).otherwise(F.col("reasons"))})
    return out.drop(*(c for c in out.columns if c.startswith("__p_")))
