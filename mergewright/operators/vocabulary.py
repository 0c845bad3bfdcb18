"""Terms of a vocabulary read anywhere in texts, by whole words, and the term that a text is taken to name.

A text becomes its words (A-Z and digits, in capitals); a decimal's two halves are words that belong together, and a term
that cuts one isn't read ("MODEL 2.0" holds no "MODEL 2", but "1.6 FSI" holds "1 6 FSI"). Terms are met by a join: a word of
a text that begins terms brings their lengths, and the windows of those lengths are joined with the terms as text. So only
words that begin a term make rows, each of them no more than the term lengths that begin with it.

A null or empty text reads nothing; a term without words is no term; a term with several targets has a hit for each;
repeated texts have hits each, and repeated terms count once; empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from .match import BROADCAST_ROWS


def marked_words(text: Column) -> Column:
    """The words of a text; one whose decimal goes on in the next word ends in ~."""
    plain = F.regexp_replace(text, "~", " ")
    joined = F.regexp_replace(plain, r"([0-9])[.,](?=[0-9])", "$1~ ")
    return F.filter(F.split(F.upper(F.regexp_replace(joined, "[^A-Za-z0-9~]+", " ")), " "), lambda w: w != "")


def _bare(words: Column) -> Column:
    return F.transform(words, lambda w: F.rtrim(w, F.lit("~")))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def read_terms(rows: DataFrame, key: str, text: str, terms: DataFrame, term: str, target: str) -> DataFrame:
    """key, place (of the first word, from 0), n_words, term (its words) and target of every term that stands in a text."""
    known = terms.select(_bare(marked_words(F.col(term))).alias("w"), F.col(target).alias("target")).where(F.size("w") > 0)
    known = stored(known.select(F.array_join("w", " ").alias("term"), F.size("w").alias("n_words"), F.element_at("w", 1).alias("first"), "target").distinct())
    begins = known.groupBy("first").agg(F.collect_set("n_words").alias("lengths"))
    longest = known.agg(F.max("n_words")).first()[0] or 1
    words = rows.select(F.col(key).alias("key"), marked_words(F.col(text)).alias("m"))
    # A condition on m beside it would be asked of the text, and its words be made twice.
    places = F.when(F.size("m") > 0, F.sequence(F.lit(0), F.size("m") - 1))
    # Of each word the window that the longest term could take, and whether a decimal goes on into it.
    each = words.select("key", F.inline(F.transform(places, lambda i: F.struct(
        i.cast("int").alias("place"), F.slice("m", i + 1, longest).alias("window"), ((i > 0) & F.get("m", F.greatest(i - 1, F.lit(0))).endswith("~")).alias("inside")))))
    each = each.withColumn("first", F.rtrim(F.col("window")[0], F.lit("~"))).where("NOT inside")
    begun = each.join(_small(begins), "first").withColumn("n_words", F.explode("lengths")).where(F.size("window") >= F.col("n_words"))
    begun = begun.where(~F.element_at("window", F.col("n_words")).endswith("~"))
    begun = begun.select("key", "place", "n_words", F.array_join(_bare(F.slice("window", 1, F.col("n_words"))), " ").alias("term"))
    return begun.join(_small(known.select("term", "target")), "term").select(F.col("key").alias(key), "place", "n_words", "term", "target")


def named(hits: DataFrame, key: str, tier: Column) -> DataFrame:
    """Of each text's hits (read_terms) the one it is taken to name: of the highest tier, then of the most letters. target is null
    where such hits have several targets (n_targets); term is then the first of them, and place the first of its places."""
    letters = F.length(F.replace("term", F.lit(" "), F.lit("")))
    # Hits are read once: summed up by target, then by order, then by text.
    each = hits.groupBy(key, tier.cast("int").alias("tier"), letters.alias("letters"), "target").agg(F.min(F.struct("term", "place")).alias("t"), F.count("*").alias("n"))
    alike = each.groupBy(key, "tier", "letters").agg(F.min("t").alias("t"), F.min("target").alias("least"), F.count("target").alias("n_targets"), F.sum("n").alias("n"))
    best = alike.groupBy(key).agg(F.max(F.struct("tier", "letters", "t", "least", "n_targets")).alias("b"), F.sum("n").alias("n_hits"))
    return best.select(key, F.col("b.t.term").alias("term"), F.col("b.t.place").alias("place"), F.when(F.col("b.n_targets") == 1, F.col("b.least")).alias("target"), F.col("b.n_targets").alias("n_targets"), F.col("b.tier").alias("tier"), "n_hits")
