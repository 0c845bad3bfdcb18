"""Joins on likeness of labels: by edits, by words, by sound, without comparing all pairs.

Edits are those of the restricted Damerau distance (a letter put in, left out or replaced, or two neighbours swapped).
Labels that are k edits apart share a segment: cut one of them into k + 1 segments with one letter left out between
neighbouring ones, and an edit, swaps included, touches one segment at most, so one stays whole and stands in the other
label within k places of its own. That is an equi join on (length, number of the segment, its text); the distance is
taken of the few pairs that meet there.

Nulls and blank labels meet nothing; repeated labels count once; an empty table gives no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, osa_similarity, phonetic_codes, tokens
from ..sources.shared import stored

#: What edits and words weigh in a label's score (fixed values).
EDIT_WEIGHT, WORD_WEIGHT = 0.65, 0.35
#: From which likeness of their makers pairs are looked at, and from which score of their labels (fixed values).
MAKER_BAR, LABEL_BAR = 0.80, 0.55
_TINY = 1e-9


def _allowed(length: Column, bar: float) -> Column:
    """Edits that a label of this length may be away from one of likeness `bar`, whichever of the two is longer."""
    longest = F.floor(length / bar + _TINY)
    return F.floor((1 - bar) * longest + _TINY).cast("int")


def _segment(length: Column, k: Column, i: Column) -> tuple[Column, Column]:
    """Where segment i of k + 1 begins (from 0) in a label of a length, and its own length."""
    room = F.greatest(length - k, F.lit(0))
    each, more = F.floor(room / (k + 1)), room % (k + 1)
    return (i * (each + 1) + F.least(i, more)).cast("int"), (each + F.when(i < more, 1).otherwise(0)).cast("int")


def _indexed(labels: DataFrame, bar: float) -> DataFrame:
    """__length, __i, __text of each segment of the labels `b`."""
    n = F.length("b")
    k = _allowed(n, bar)

    def one(i: Column) -> Column:
        start, size = _segment(n, k, i)
        return F.struct(n.alias("__length"), i.alias("__i"), F.substring("b", start + 1, size).alias("__text"))

    return labels.select("b", F.inline(F.transform(F.sequence(F.lit(0), k), one)))


def _probes(labels: DataFrame, bar: float) -> DataFrame:
    """__length, __i, __text of whatever segment of another label may stand in the labels `a`."""
    n = F.length("a")

    def of_length(other: Column) -> Column:
        k = _allowed(other, bar)

        def of_segment(i: Column) -> Column:
            start, size = _segment(other, k, i)
            first, last = F.greatest(F.lit(0), start - k), F.least(n - size, start + k)
            places = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda p: F.struct(other.alias("__length"), i.alias("__i"), F.substring(F.col("a"), p + 1, size).alias("__text")))

        return F.flatten(F.transform(F.sequence(F.lit(0), k), of_segment))

    lengths = F.sequence(F.greatest(F.lit(1), F.ceil(n * bar - _TINY).cast("int")), F.floor(n / bar + _TINY).cast("int"))
    return labels.select("a", F.inline(F.array_distinct(F.flatten(F.transform(lengths, of_length)))))


def _labels(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.select(F.col(column).alias(name)).where(F.length(name) > 0).distinct()


def similar_labels(left: DataFrame, a: str, right: DataFrame, b: str, bar: float) -> DataFrame:
    """a, b and edit (likeness, 1 - distance / the longer length) of all pairs of distinct labels with a likeness of at least
    `bar`, which is above 0; labels are compared as they are, letter by letter."""
    if not 0 < bar <= 1:
        raise ValueError("the bar has to be above 0 and at most 1")
    met = _probes(_labels(left, a, "a"), bar).join(_indexed(_labels(right, b, "b"), bar), ["__length", "__i", "__text"]).select("a", "b").distinct()
    return met.withColumn("edit", osa_similarity("a", "b")).where(F.col("edit") >= bar - _TINY)


def sharing_words(left: DataFrame, right: DataFrame, share: float) -> DataFrame:
    """a and b of pairs of labels whose Jaccard of distinct words is at least `share` (above 0), or where the words of `a` are
    some of those of `b`.

    Words are ordered from the rarest (in `right`) on. Pairs of Jaccard j share floor(j * m) words of m at least, so they
    meet in the first m - that + 1 of either side; for the words of a subset any one of them will do, and its rarest is taken.
    """
    each = right.select("b", F.explode(tokens(F.col("b"))).alias("__w"))
    rows = stored(each.groupBy("__w").agg(F.count("*").alias("__rows")))

    def first_words(labels: DataFrame, name: str, least: Column) -> DataFrame:
        words = labels.select(name, F.size(tokens(F.col(name))).alias("__m"), F.explode(tokens(F.col(name))).alias("__w")).join(rows, "__w", "left")
        order = Window.partitionBy(name).orderBy(F.coalesce("__rows", F.lit(0)), "__w")
        return words.withColumn("__at", F.row_number().over(order)).where(F.col("__at") <= F.col("__m") - least + 1).select(name, "__w", "__at")

    needed = F.greatest(F.lit(1), F.ceil(share * F.col("__m") - _TINY))
    heads, others = first_words(left, "a", needed), first_words(right, "b", needed)
    alike = heads.join(others, "__w").select("a", "b")
    within = heads.where("__at = 1").select("a", "__w").join(each, "__w").select("a", "b")
    return alike.unionByName(within).distinct()


def label_scores(left: DataFrame, a: str, right: DataFrame, b: str, bar: float = LABEL_BAR) -> DataFrame:
    """a, b and text_score of all pairs of comparison texts with a score of at least `bar`.

    The score of two single words is the likeness by edits of their letters without spaces; of others EDIT_WEIGHT of it
    and WORD_WEIGHT of the words' Jaccard; and where the words of `a` are some of b's, but not all, LABEL_BAR at least.
    Without a common word edits alone must reach the bar, so pairs come from an edit join at bar / EDIT_WEIGHT; with one
    from a join on words. The score is taken once for each pair of labels.
    """
    x, y = _labels(left, a, "a"), _labels(right, b, "b")
    letters = lambda df, c: df.select(c, F.replace(F.col(c), F.lit(" "), F.lit("")).alias("__letters"))
    one = lambda df, c: df.where(~F.col(c).contains(" "))
    met = similar_labels(one(x, "a"), "a", one(y, "b"), "b", bar).select("a", "b")
    if bar <= EDIT_WEIGHT:
        near = similar_labels(letters(x, "a"), "__letters", letters(y, "b"), "__letters", bar / EDIT_WEIGHT)
        near = near.withColumnsRenamed({"a": "__la", "b": "__lb"}).select("__la", "__lb")
        met = met.unionByName(near.join(letters(x, "a").withColumnRenamed("__letters", "__la"), "__la").join(letters(y, "b").withColumnRenamed("__letters", "__lb"), "__lb").select("a", "b"))
    # Of words alone: the share that must be common where all letters are.
    met = stored(met.unionByName(sharing_words(x, y, max(0.01, (bar - EDIT_WEIGHT) / WORD_WEIGHT))).distinct())
    ta, tb = tokens(F.col("a")), tokens(F.col("b"))
    edit = osa_similarity(F.replace(F.col("a"), F.lit(" "), F.lit("")), F.replace(F.col("b"), F.lit(" "), F.lit("")))
    some = (F.size(F.array_except(ta, tb)) == 0) & (F.size(ta) < F.size(tb))
    whole = F.when(F.col("a").contains(" ") | F.col("b").contains(" "), EDIT_WEIGHT * F.col("edit") + WORD_WEIGHT * jaccard(ta, tb)).otherwise(F.col("edit"))
    scored = met.withColumn("edit", edit).withColumn("text_score", F.round(F.when(some, F.greatest(whole, F.lit(LABEL_BAR))).otherwise(whole), 6))
    return scored.where(F.col("text_score") >= bar - _TINY).select("a", "b", "text_score")


def best_labels(scores: DataFrame, candidates: DataFrame, reference: str, label: str) -> DataFrame:
    """a, reference, text_score and matched_label: the best of a candidate's labels (one row for each name or alias) for each
    `a`; of equal scores the label of fewer words, then the shorter one, then the one that sorts last."""
    of = candidates.select(reference, F.col(label).alias("b")).where(F.length("b") > 0).distinct()
    order = F.struct("text_score", (-F.size(tokens(F.col("b")))).alias("w"), (-F.length("b")).alias("n"), F.col("b"))
    best = scores.join(of, "b").groupBy("a", reference).agg(F.max(order).alias("m"))
    return best.select("a", reference, F.col("m.text_score").alias("text_score"), F.col("m.b").alias("matched_label"))


def maker_scopes(queries: DataFrame, maker: str, candidates: DataFrame, known: str, bar: float = MAKER_BAR) -> DataFrame:
    """maker, known and scope: the known makers that a query's maker stands for, by the first level that finds any: the same
    (exact_manufacturer), a likeness of `bar` (fuzzy_manufacturer), or half of it and a common sound (phonetic_manufacturer).
    Only distinct makers are joined, and those without a hit travel on; a maker that nothing matches has no row."""
    makers, names = _labels(queries, maker, "a"), _labels(candidates, known, "b")
    exact = makers.join(names, F.col("a") == F.col("b")).select("a", "b", F.lit("exact_manufacturer").alias("scope"))
    left = makers.join(names, F.col("a") == F.col("b"), "left_anti")
    bare = lambda df, c: df.select(c, F.replace(F.col(c), F.lit(" "), F.lit("")).alias("__letters"))
    pairs = similar_labels(bare(left, "a"), "__letters", bare(names, "b"), "__letters", bar).select(F.col("a").alias("__la"), F.col("b").alias("__lb"))
    fuzzy = stored(pairs.join(bare(left, "a").withColumnRenamed("__letters", "__la"), "__la").join(bare(names, "b").withColumnRenamed("__letters", "__lb"), "__lb").select("a", "b", F.lit("fuzzy_manufacturer").alias("scope")))
    left = left.join(fuzzy, "a", "left_anti")
    sound = lambda df, c: df.select(c, F.explode(phonetic_codes(F.col(c))).alias("__sound"))
    heard = sound(left, "a").join(sound(names, "b"), "__sound").select("a", "b").distinct()
    near = osa_similarity(F.replace(F.col("a"), F.lit(" "), F.lit("")), F.replace(F.col("b"), F.lit(" "), F.lit(""))) >= bar / 2 - _TINY
    phonetic = heard.where(near).select("a", "b", F.lit("phonetic_manufacturer").alias("scope"))
    return exact.unionByName(fuzzy).unionByName(phonetic).select(F.col("a").alias(maker), F.col("b").alias(known), "scope")
