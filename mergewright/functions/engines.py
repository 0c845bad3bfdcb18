"""Engine codes as column expressions: forms, lists, families, and how a record's code relates to a candidate's codes.

A code may carry an alternative in brackets, and a value may list several codes between commas. Two codes are the same
engine where they share a form: the whole value, the part outside brackets, or a part within, each as capitals and digits
alone. Null and blank codes have no forms; repeated codes count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BRACKET = r"\([^()]*\)"
#: A code that ends in one revision letter after a digit names its family without it.
REVISION = "^([A-Z0-9]*[0-9])[A-Z]$"


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9ÅÄÖÉÜ]", "")


def _head(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(c), BRACKET, " "))


def _some(c: Column) -> Column:
    """An array without nulls, blanks and repeats; a null array is empty."""
    return F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != ""))


def name(code: Column) -> Column:
    """A code's own name, without its alternative in brackets."""
    return _bare(_head(code))


def forms(code: Column) -> Column:
    """The forms under which a code is the same engine."""
    inner = F.transform(F.regexp_extract_all(F.upper(code), F.lit(r"\(([^()]*)\)")), _bare)
    return _some(F.concat(F.array(_bare(code), name(code)), F.coalesce(inner, F.array().cast("array<string>"))))


def parts(value: Column) -> Column:
    """The codes that a value lists, repeats once, in order."""
    each = F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: _bare(x) != "")
    keys = F.transform(each, _bare)
    return F.filter(each, lambda x, i: F.array_position(keys, _bare(x)) == i + 1)


def _family_of(head: Column) -> Column:
    return F.when((F.length(head) >= 3) & ~head.rlike("^[0-9]+$"), head)


def _tokens(code: Column) -> Column:
    return F.filter(F.split(_head(code), r"[\s\-]+"), lambda x: x != "")


def family(code: Column, revision: bool = True) -> Column:
    """The family that a code of several tokens begins with, or that a single one names before its revision letter; null where
    it has none, or one of under three characters or of digits alone."""
    tokens, stem = _tokens(code), F.regexp_extract(name(code), REVISION, 1)
    single = (F.size(tokens) == 1) & (stem != "") if revision else F.lit(False)
    return _family_of(F.when(single, stem).when(F.size(tokens) >= 2, _bare(F.element_at(tokens, 1))))


def families(code: Column) -> Column:
    """All families of a code: also that of one written in several tokens that ends in a revision letter. A list has its
    first one alone."""
    stem = F.when((F.size(_tokens(code)) >= 2) & ~F.contains(code, F.lit(",")), F.regexp_extract(name(code), REVISION, 1))
    return _some(F.array(family(code), _family_of(stem)))


def known_names(codes: Column) -> Column:
    """Under what a candidate makes its codes known: their forms and first-token families."""
    return _some(F.flatten(F.transform(_some(codes), lambda c: F.concat(forms(c), F.array(family(c, False))))))


def with_known(queries: DataFrame, code: str, candidates: DataFrame, codes: str) -> DataFrame:
    """queries with code_known: whether any candidate (codes: an array) carries the query's code or its family. Distinct codes
    are joined with distinct names."""
    names = candidates.select(F.explode(known_names(F.col(codes))).alias("__name")).distinct()
    asked = queries.select(code).where(F.col(code).isNotNull()).distinct()
    each = asked.select(code, F.explode(_some(F.concat(forms(F.col(code)), F.array(family(F.col(code), False))))).alias("__name"))
    hit = each.join(names, "__name", "left_semi").select(F.col(code).alias("__code")).distinct()
    joined = queries.join(hit, F.col(code) == F.col("__code"), "left")
    return joined.withColumn("code_known", F.col("__code").isNotNull()).drop("__code")


def described(code: Column) -> Column:
    """What relation() needs of a query's code; to be taken once for each record (or distinct code)."""
    return F.struct(
        forms(code).alias("mine"), families(code).alias("families"), F.coalesce(family(code), _bare(code)).alias("one"), F.transform(parts(code), forms).alias("listed"), F.contains(code, F.lit(",")).alias("many"),
    )


def described_set(codes: Column) -> Column:
    """What relation() needs of a candidate's codes (an array); to be taken once for each candidate."""
    own = _some(codes)
    return F.struct(
        F.transform(own, forms).alias("each"), _some(F.flatten(F.transform(own, forms))).alias("on"), _some(F.transform(own, name)).alias("names"), _some(F.flatten(F.transform(own, families))).alias("families"),
        F.transform(own, lambda c: F.coalesce(family(c), _bare(c))).alias("one"),
    )


def relation(code: Column, codes: Column, known: Column, aliases: Column | None = None, shared: Column | None = None, drivetrain: Column | None = None) -> Column:
    """How a query's code (described) relates to a candidate's codes (described_set); null where the query has none.

    In order: missing (the candidate has no codes); a list of codes (below); engine_code_family where a reviewed name is
    shared by two engines (shared: names); engine_code for a common form; engine_code_alias for a reviewed other name
    (aliases: names); engine_code_family where one side names only the other's family; engine_code_unverified where no
    candidate anywhere knows the code; conflict.

    A list whose every code is on the candidate is engine_code_list, but engine_code where it names a whole drivetrain
    (drivetrain), and engine_code_family where the candidate has engines besides. Any other list reads as one code.
    """
    none = F.array().cast("array<string>")
    meet = lambda a, b: F.arrays_overlap(F.coalesce(a, none), F.coalesce(b, none))
    mine, on, listed = code["mine"], codes["on"], code["listed"]
    every = F.forall(listed, lambda f: F.arrays_overlap(f, on))
    whole = F.forall(codes["each"], lambda f: F.arrays_overlap(f, F.flatten(listed)))
    family_hit = F.array_contains(on, code["one"]) | meet(codes["one"], mine)
    as_one = F.when(meet(mine, on), "engine_code").when(family_hit, "engine_code_family").when(known, "conflict").otherwise("engine_code_unverified")
    many = (
        F.when(meet(mine, on) | (F.size(listed) == 0) | ~every, as_one)
        .when(whole & (F.lit(False) if drivetrain is None else F.coalesce(drivetrain, F.lit(False))), "engine_code")
        .when(~whole, "engine_code_family").otherwise("engine_code_list")
    )
    single = (
        F.when(meet(shared if shared is not None else none, codes["names"]), "engine_code_family")
        .when(meet(mine, on), "engine_code")
        .when(meet(aliases if aliases is not None else none, codes["names"]), "engine_code_alias")
        .when(meet(code["families"], on) | meet(codes["families"], mine), "engine_code_family")
        .when(known, "conflict").otherwise("engine_code_unverified")
    )
    return F.when(F.size(mine) == 0, F.lit(None)).when(F.size(on) == 0, "missing").when(code["many"], many).otherwise(single)
