"""A grammar reads a text once, and texts that hold its own mark as any other."""

from mergewright.operators.grammar import Alternative, Take, compile_grammar
from pyspark.sql import functions as F

KINDS = {"a": "string", "b": "int"}
BOTH = [Alternative("bound", r"^([^ ]+) (\d+)?", {"a": [Take(1)], "b": [Take(2)]}, {"b": (1, 5)}), Alternative("any", r"([^ ]+)$", {"a": [Take(1)]})]


def test_marks_groups_bounds_and_rest(spark):
    rows = [("xy 3 z",), ("x 4 z",), ("x 9 z",), ("p q",), (None,), (" ",)]
    got = spark.createDataFrame(rows, "t string").select("t", compile_grammar(F.col("t"), BOTH, KINDS).alias("g"))
    assert {r.t: r.g and tuple(r.g) for r in got.collect()} == {"xy 3 z": ("bound", "xy", 3, "z"), "x 4 z": ("bound", "x", 4, "z"), "x 9 z": ("any", "z", None, "x 9"), "p q": ("any", "q", None, "p"), None: None, " ": None}


def test_the_text_is_worked_out_once(spark):
    text = F.concat(F.lit("only here"), F.col("t"))
    plan = spark.createDataFrame([("1",)], "t string").select(compile_grammar(text, BOTH, KINDS).alias("g"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("only here") == 1
