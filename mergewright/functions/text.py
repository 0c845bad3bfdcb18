"""Cleaning, keys and similarity of text values, as column expressions.

Blank text is absence everywhere, and a value that isn't a number is null rather than an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


#: Letters that sound as one, in this order, and the groups of consonants (fixed values).
DIGRAPHS = [("PH", "F"), ("SCH", "SK"), ("SH", "S"), ("CH", "K"), ("TH", "T")]
SOUNDS = ("BPFVWCGJKQXDTSZ", "PPPPPKKKKKKTTSS")


def blank_to_null(c: Column) -> Column:
    """Trimmed text; null where nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def cleaned(c: Column, absent: tuple[str, ...] = ("UNKNOWN", "-")) -> Column:
    """Blank text and the words for absence as null."""
    t = blank_to_null(c)
    return F.when(~F.upper(t).isin(*absent), t)


def guarded_int(c: Column) -> Column:
    """A whole number in text as long; null where it isn't one."""
    t = F.trim(c)
    return F.when(t.rlike(r"^-?[0-9]+$"), t.try_cast("bigint"))


def guarded_decimal(c: Column) -> Column:
    """A number in text, whole or with decimals, exactly (28 digits before the point, ten behind it); null where it isn't one."""
    t = F.trim(c.cast("string"))
    return F.when(t.rlike(r"^-?[0-9]+([.][0-9]+)?$"), t.try_cast("decimal(38,10)"))


def measure(c: Column) -> Column:
    """A whole number in which 0 means that nothing was recorded."""
    return F.nullif(guarded_int(c), F.lit(0).cast("long"))


def scaled(c: Column, factor: str, digits: int) -> Column:
    """A decimal measure times a factor, rounded half up."""
    return F.round(c.cast("decimal(18,6)") * F.lit(factor).cast("decimal(18,6)"), digits).cast(f"decimal(18,{digits})")


def partial_date(c: Column) -> Column:
    """(value, precision) of yyyymmdd, yyyymm or yyyy text; the last day that it may mean. Null for anything else."""
    t = F.trim(c)
    month = F.last_day(F.try_to_date(F.concat(F.substring(t, 1, 6), F.lit("01")), "yyyyMMdd"))
    value = F.when(t.rlike(r"^[0-9]{8}$"), F.try_to_date(t, "yyyyMMdd")).when(t.rlike(r"^[0-9]{6}$"), month).when(t.rlike(r"^[0-9]{4}$"), F.try_to_date(F.concat(t, F.lit("1231")), "yyyyMMdd"))
    precision = F.when(F.length(t) == 8, "day").when(F.length(t) == 6, "month").when(F.length(t) == 4, "year")
    return F.struct(value.alias("value"), F.when(value.isNotNull(), precision).alias("precision"))


def comparison_text(c: Column) -> Column:
    """Upper-case letters and digits; every run of anything else is one space."""
    return F.trim(F.regexp_replace(F.upper(c), r"[^A-Z0-9]+", " "))


def compact(c: Column) -> Column:
    """Upper-case letters and digits alone."""
    return F.regexp_replace(F.upper(c), r"[^A-Z0-9]", "")


def shape(c: Column) -> Column:
    """Digits as 9, capitals as A, small letters as a."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "9"), "[A-Z]", "A"), "[a-z]", "a")


def leading_token(c: Column) -> Column:
    return F.regexp_extract(F.trim(c), r"^(\S+)", 1)


def phonetic(c: Column) -> Column:
    """A consonant skeleton: like-sounding letters are one, repeats are one, vowels after the first letter go.

    Null for fewer than three letters.
    """
    t = F.regexp_replace(F.upper(c), "[^A-Z]", "")
    groups = F.translate(t, "BPFVCKQGXSZDTMNLRJWY", "PPFFKKKKKSSTTNNLRIVI")
    first, rest = F.substring(groups, 1, 1), F.regexp_replace(F.substring(groups, 2, 1_000_000), "[AEIOUH]", "")
    return F.when(F.length(t) >= 3, F.regexp_replace(F.concat(first, rest), r"(.)\1+", "$1"))


def phonetic_codes(c: Column) -> Column:
    """The distinct sound codes of the words of a text, in order: words of three letters or more without digits.

    Digraphs and soft C become single letters first; then like-sounding consonants are one, H and vowels after the first
    letter go, and repeats are one. Accents should be folded before.
    """
    words = F.filter(F.regexp_extract_all(F.upper(c), F.lit(r"([A-Z0-9]+)")), lambda w: w.rlike("^[A-Z]{3,}$"))

    def code(w: Column) -> Column:
        for letters, one in DIGRAPHS:
            w = F.replace(w, F.lit(letters), F.lit(one))
        w = F.regexp_replace(w, "C([EIY])", "S$1")
        # Vowels stay where a word begins with one; H never does.
        body = F.regexp_replace(F.substring(w, 2, 1_000_000), "[AEIOUY]", "")
        grouped = F.replace(F.translate(F.concat(F.substring(w, 1, 1), body), *SOUNDS), F.lit("H"), F.lit(""))
        return F.when(F.length(w) >= 3, F.regexp_replace(grouped, r"(.)\1+", "$1"))

    return F.array_sort(F.array_distinct(F.filter(F.transform(words, code), lambda x: F.coalesce(x, F.lit("")) != "")))


def tokens(c: Column) -> Column:
    """The distinct words of a comparison text, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.split(comparison_text(c), " "), lambda x: x != "")))


def jaccard(a: Column, b: Column) -> Column:
    """Common share of two arrays of distinct words; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / the longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def osa_distances(left: list[str], right: list[str]) -> np.ndarray:
    """Edits with swaps of neighbours, each part of a text changed once, of many pairs at a time.

    The table of all pairs is filled along its rows together; what lies beyond a pair's own lengths is never read.
    """
    rows, columns = (np.fromiter(map(len, x), np.int64, len(x)) for x in (left, right))
    a, b = (np.zeros((len(left), max(1, int(n.max(initial=0)))), np.uint32) for n in (rows, columns))
    for codes, texts, lengths in ((a, left, rows), (b, right, columns)):
        codes[np.arange(codes.shape[1]) < lengths[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    steps = np.arange(b.shape[1] + 1)
    before, last = None, np.broadcast_to(steps, (len(left), len(steps))).astype(np.int32)
    out = np.where(rows == 0, columns, 0)
    for i in range(1, a.shape[1] + 1):
        best = np.empty_like(last)
        best[:, 0] = i
        best[:, 1:] = np.minimum(last[:, 1:] + 1, last[:, :-1] + (a[:, i - 1, None] != b))
        if i > 1 and b.shape[1] > 1:
            swapped = (a[:, i - 1, None] == b[:, :-1]) & (a[:, i - 2, None] == b[:, 1:])
            best[:, 2:] = np.where(swapped, np.minimum(best[:, 2:], before[:, :-2] + 1), best[:, 2:])
        # Insertions run along the row: the least of what stands at or before a place, one more for each step.
        best = np.minimum.accumulate(best - steps, axis=1) + steps
        before, last = last, best.astype(np.int32)
        done = rows == i
        out[done] = last[done, columns[done]]
    return out


def osa_similarities(left: list[str], right: list[str]) -> np.ndarray:
    """1 - restricted Damerau distance / the longer length, pairs of like length together; 1 for two empty texts."""
    longer = np.array([max(len(a), len(b)) for a, b in zip(left, right, strict=True)], np.int64)
    out = np.ones(len(left))
    order = np.argsort(longer, kind="stable")
    order = order[longer[order] > 0]
    start = 0
    while start < len(order):
        # About four million cells at a time, one pair at least.
        some = order[start : start + max(1, 4_000_000 // int(longer[order[start]]) ** 2)]
        some = some[longer[some] <= 2 * longer[some[0]]]
        out[some] = 1 - osa_distances([left[i] for i in some], [right[i] for i in some]) / longer[some]
        start += len(some)
    return out


@F.pandas_udf(DoubleType())
def osa_similarity(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """1 - restricted Damerau distance / the longer length; null where a text is. Give it distinct pairs and join the result back."""
    for left, right in pairs:
        known = (left.notna() & right.notna()).to_numpy()
        out = np.full(len(left), np.nan)
        out[known] = osa_similarities(left[known].tolist(), right[known].tolist())
        yield pd.Series(out).where(known, None)


@F.pandas_udf(StringType())
def folded(values: pd.Series) -> pd.Series:
    """NFKC text without accents, in upper case: for keys that tolerate spelling."""
    decomposed = values.str.normalize("NFKD")
    return decomposed.str.replace(r"[̀-ͯ]", "", regex=True).str.normalize("NFKC").str.upper()
