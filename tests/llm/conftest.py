import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that the operators use for columns of their own.
CLASHING = ["id", "n", "label", "score", "size", "hash", "ids", "key", "word", "whole", "cut", "row", "margin", "features", "block", "component", "digest", "y", "repeats", "__copy", "copy", "whole_row", "rank", "range"]


def make_docs(spark, rows, extra=True):
    """documents from (doc_id, text, source), with further columns whose names clash with the operators' own."""
    own = spark.createDataFrame([(d, t, "en", s, None if t is None else len(t)) for d, t, s in rows], DOCS)
    from pyspark.sql import functions as F

    return own.withColumns({c: F.lit(f"x-{c}") for c in CLASHING}) if extra else own


def words(n, seed=0):
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def docs_of(spark):
    from mergewright.llm import common

    common.prepare(spark)
    return lambda rows, extra=True: make_docs(spark, rows, extra)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    a, b = words(80, 1), words(60, 2)
    return [
        (1, a, "s1"), (2, a + " tail", "s1"), (3, b, "s2"), (3, b, "s2"), (3, b, "s2"),
        (4, None, "s1"), (5, "", None), (6, " \t\n ", "s3"), (None, a, None), (None, words(55, 3), "s2"), (None, None, None),
        (7, "x", "s1"), (8, "naïve Ünï çödé 漢字 🙂🙂\r\n\tTab", "s2"), (9, words(30_000, 4), "s2"), (10, "long" * 50_000, "s3"),
        # Spaces that don't part words: 14 is two words.
        (11, "A b C d", "s1"), (12, "a B c D", "s1"), (13, "<|endoftext|> \x00 zero \x1c", "ß"), (14, "a\u00a0b c\u2003d", "s1"),
    ]


@pytest.fixture(scope="session")
def label_rows(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
