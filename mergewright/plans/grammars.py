"""Queries of two grammars through one compiler: tyre sizes, and type approvals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grammar import Alternative, Take, compile_grammar
from .registry import Tables, query

#: What marks of construction stand for (fixed values).
CONSTRUCTION = {"R": "radial", "ZR": "radial", "RF": "radial", "ZRF": "radial", "B": "belted_bias", "D": "bias", "-": "bias"}
_SPACED = {"Z R": "radial", "Z RF": "radial"}
_SERVICE = r"(?:\s*(\d{2,3})\s*([A-Z])?)?(?:\s*/\s*(?:(4|6|8|10)|(REINF[A-Z]*)))?"
TYRE = {
    "size_system": "string", "section_width_mm": "int", "section_width_in": "double", "aspect_ratio": "int", "construction": "string", "rim_diameter_in": "double", "rim_diameter_mm": "int", "overall_diameter_mm": "int", "overall_diameter_in": "double",
    "load_index": "int", "speed_symbol": "string", "load_range": "string", "load_letter": "string", "ply_rating": "int", "run_flat": "boolean", "mud_snow": "boolean",
}


def _is(v) -> list[Take]:
    return [Take(constant=v)]


def _service(at: int) -> dict[str, list[Take]]:
    """Fields of the service description, whose groups begin at `at`; the group before it says whether a tyre is commercial."""
    return {"load_index": [Take(at)], "ply_rating": [Take(at + 2)], "load_range": [Take(at + 3, other=None, words={"REINF": "xl"}), Take(at - 1, table={"C": "c"})]}


#: Sizes in the order in which they are tried: metric first, flotation last (formats are fixed values).
TYRES = [
    Alternative("metric", r"^(P|LT|HL)?\s*(\d{3})\s*/\s*(\d{2})\s*(?:/\s*(?=Z?R))?(Z\s?RF|RF|Z\s?R|[SHV]R|R|B|D|-)?\s*(\d{2}(?:\.\d)?)\s*(C)?\s*(?:\.\s+|-\s*)?(?:\(\s*(\d{2,3})\s*\)|(\d{2,3}))?\s*([A-Z]{1,2})?\s*(.*)$", {
        "size_system": [Take(1, table={"P": "p_metric", "LT": "lt_metric"}, other="metric")], "section_width_mm": [Take(2)], "aspect_ratio": [Take(3)], "construction": [Take(4, table=CONSTRUCTION | _SPACED, other="radial")],
        "run_flat": [Take(4, table={"RF": True, "ZRF": True, "Z RF": True})], "rim_diameter_in": [Take(5)], "load_index": [Take(8), Take(7)], "speed_symbol": [Take(9), Take(4, table={"SR": "S", "HR": "H", "VR": "V"})],
        "load_range": [Take(1, table={"HL": "hl"}), Take(10, words={"XL": "xl", "REINF": "xl"}), Take(6, table={"C": "c"})], "mud_snow": [Take(10, words={"M+S": True, "M+ S": True})],
    }),
    Alternative("alpha", r"^(\d{3})\s*([A-Z])?R\s*(\d{2})\s*(C)?" + _SERVICE + "$", {"size_system": _is("alpha"), "section_width_mm": [Take(1)], "construction": _is("radial"), "rim_diameter_in": [Take(3)], "speed_symbol": [Take(6), Take(2)], **_service(5)}),
    Alternative("imperial", r"^(\d(?:\.\d{2})?)\s*-\s*(\d{2})$", {"size_system": _is("imperial"), "section_width_in": [Take(1)], "construction": _is("bias"), "rim_diameter_in": [Take(2)]}),
    Alternative("dash", r"^(\d{3})\s*-\s*(\d{2})$", {"size_system": _is("metric"), "section_width_mm": [Take(1)], "construction": _is("bias"), "rim_diameter_in": [Take(2)]}),
    Alternative("imperial_full", r"^(\d{1,2}\.\d{2})\s*([SHV])?\s*(R|-)\s*(\d{2}(?:\.5)?)\s*(C)?" + _SERVICE + "$", {
        "size_system": _is("imperial"), "section_width_in": [Take(1)], "construction": [Take(3, table={"R": "radial", "-": "bias"})], "rim_diameter_in": [Take(4)], "speed_symbol": [Take(7), Take(2)], **_service(6),
    }, {"section_width_in": (3.5, 16.0)}),
    Alternative("alphanumeric", r"^([A-N])\s*([RB])?\s*(50|60|70|78)\s*-\s*(\d{2})$", {"size_system": _is("alphanumeric"), "load_letter": [Take(1)], "aspect_ratio": [Take(3)], "construction": [Take(2, table=CONSTRUCTION, other="bias")], "rim_diameter_in": [Take(4)]}),
    Alternative("pax", r"^(\d{3})\s*/\s*(\d{3})\s*R\s*(\d{3})\s*(A)?(?:\s*(\d{2,3})\s*([A-Z]))?$", {"size_system": _is("pax"), "section_width_mm": [Take(1)], "overall_diameter_mm": [Take(2)], "construction": _is("radial"), "rim_diameter_mm": [Take(3)], "run_flat": _is(True), "load_index": [Take(5)], "speed_symbol": [Take(6)]}),
    Alternative("mm_rim", r"^(\d{3})\s*(R|-)\s*(315|340|365|380|390|400|415)$", {"size_system": _is("metric"), "section_width_mm": [Take(1)], "construction": [Take(2, table=CONSTRUCTION)], "rim_diameter_mm": [Take(3)]}),
    Alternative("flotation", r"^(\d{2})\s*X\s*(\d{1,2}\.\d{1,2})\s*R\s*(\d{2})\s*(LT)?$", {"size_system": _is("flotation"), "overall_diameter_in": [Take(1)], "section_width_in": [Take(2)], "construction": _is("radial"), "rim_diameter_in": [Take(3)], "load_range": [Take(4, table={"LT": "lt"})]}),
]


def cleaned_tyre(text):
    return F.trim(F.regexp_replace(F.upper(F.replace(text, F.lit(","), F.lit("."))), r"\s+", " "))


#: Sizes spelled from numbers of a line (w, a, r, v), in thirteen ways; SQL that either engine reads.
_NUMBERS = "CAST(145 + 10 * (l_orderkey % 19) AS INT) AS w, CAST(30 + 5 * (l_orderkey % 9) AS INT) AS a, CAST(13 + l_orderkey % 8 AS INT) AS r, CAST(70 + l_orderkey % 50 AS INT) AS v, (l_orderkey + l_linenumber) % 13 AS way, l_orderkey, l_linenumber"
_S = {n: f"CAST({n} AS STRING)" for n in "warv"}
_TYRE_TEXT = f"""CASE way WHEN 0 THEN {_S['w']} || '/' || {_S['a']} || ' r' || {_S['r']} || ' ' || {_S['v']} || 'V XL' WHEN 1 THEN 'LT ' || {_S['w']} || ' / ' || {_S['a']} || 'Z RF' || {_S['r']} || '  (' || {_S['v']} || ') M+S' WHEN 2 THEN {_S['w']} || 'SR' || {_S['r']} || 'C ' || {_S['v']} || 'T/6'
WHEN 3 THEN '5,60-' || {_S['r']} WHEN 4 THEN {_S['w']} || '-' || {_S['r']} WHEN 5 THEN '7.25R' || {_S['r']} || ' ' || {_S['v']} || '/reinforced' WHEN 6 THEN 'ER78-' || {_S['r']} WHEN 7 THEN {_S['w']} || '/700R480A ' || {_S['v']} || 'W' WHEN 8 THEN {_S['w']} || ' R390'
WHEN 9 THEN '31x10.50R' || {_S['r']} || ' LT' WHEN 10 THEN '29.04R' || {_S['r']} WHEN 11 THEN 'axle ' || {_S['w']} ELSE NULL END"""


@query(f"""WITH n AS (SELECT {_NUMBERS} FROM lineitem)
SELECT l_orderkey, l_linenumber, ['metric', 'metric', 'alpha', 'imperial', 'dash', 'imperial_full', 'alphanumeric', 'pax', 'mm_rim', 'flotation'][way + 1] AS alternative,
['metric', 'lt_metric', 'alpha', 'imperial', 'metric', 'imperial', 'alphanumeric', 'pax', 'metric', 'flotation'][way + 1] AS size_system, CASE WHEN way IN (0, 1, 2, 4, 7, 8) THEN w END AS section_width_mm, CASE way WHEN 3 THEN 5.6 WHEN 5 THEN 7.25 WHEN 9 THEN 10.5 END::DOUBLE AS section_width_in,
CASE WHEN way IN (0, 1) THEN a WHEN way = 6 THEN 78 END AS aspect_ratio, CASE WHEN way IN (3, 4) THEN 'bias' WHEN way < 10 THEN 'radial' END AS construction, CASE WHEN way NOT IN (7, 8) AND way < 10 THEN r END::DOUBLE AS rim_diameter_in, CASE way WHEN 7 THEN 480 WHEN 8 THEN 390 END AS rim_diameter_mm,
CASE WHEN way = 7 THEN 700 END AS overall_diameter_mm, CASE WHEN way = 9 THEN 31 END::DOUBLE AS overall_diameter_in, CASE WHEN way IN (0, 1, 2, 5, 7) THEN v END AS load_index, CASE way WHEN 0 THEN 'V' WHEN 1 THEN 'M' WHEN 2 THEN 'T' WHEN 7 THEN 'W' END AS speed_symbol,
CASE way WHEN 0 THEN 'xl' WHEN 2 THEN 'c' WHEN 5 THEN 'xl' WHEN 9 THEN 'lt' END AS load_range, CASE WHEN way = 6 THEN 'E' END AS load_letter, CASE WHEN way = 2 THEN 6 END AS ply_rating, CASE WHEN way IN (1, 7) THEN true END AS run_flat, NULL::BOOLEAN AS mud_snow FROM n""")
def tyre_grammar(t: Tables) -> DataFrame:
    """Sizes of nine kinds, and some that no kind reads. "M+S" right behind a load index gives its M away as a speed, as in any
    reader that takes a speed of one letter there."""
    lines = t.lineitem.selectExpr(*_NUMBERS.split(", "))
    read = lines.withColumn("g", compile_grammar(cleaned_tyre(F.expr(_TYRE_TEXT)), TYRES, TYRE))
    return read.select("l_orderkey", "l_linenumber", "g.alternative", *(f"g.{c}" for c in TYRE))


APPROVAL = [
    Alternative("whole", r"^[Ee]([0-9]{1,2})\*([0-9]{2,4}/[0-9]{1,4})\*([0-9]{1,5})\*([0-9]{1,3})", {"country": [Take(1)], "directive": [Take(2)], "number": [Take(3)], "extension": [Take(4)]}, {"country": (1, 60)}),
    Alternative("without_extension", r"^[Ee]([0-9]{1,2})\*([0-9]{2,4}/[0-9]{1,4})\*([0-9]{1,5})", {"country": [Take(1)], "directive": [Take(2)], "number": [Take(3)]}, {"country": (1, 60)}),
    Alternative("national", r"^N([0-9]+)", {"number": [Take(1)]}),
]
_APPROVAL_TEXT = "CASE o_orderkey % 5 WHEN 0 THEN 'e' || CAST(1 + o_custkey % 70 AS STRING) || '*2001/116*' || CAST(o_orderkey % 10000 AS STRING) || '*' || CAST(o_custkey % 100 AS STRING) || ' x y' WHEN 1 THEN 'E4*70/156*' || CAST(o_orderkey % 10000 AS STRING) WHEN 2 THEN 'N' || CAST(o_orderkey AS STRING) || '-' WHEN 3 THEN 'none' END"


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderkey % 5 AS way, 1 + o_custkey % 70 AS c FROM orders)
SELECT o_orderkey, CASE WHEN way = 0 AND c <= 60 THEN 'whole' WHEN way = 1 THEN 'without_extension' WHEN way = 2 THEN 'national' END AS alternative, CASE WHEN way = 0 AND c <= 60 THEN c WHEN way = 1 THEN 4 END::INT AS country, CASE WHEN way = 0 AND c <= 60 THEN '2001/116' WHEN way = 1 THEN '70/156' END AS directive,
CASE WHEN way = 2 THEN o_orderkey WHEN way = 1 OR (way = 0 AND c <= 60) THEN o_orderkey % 10000 END::BIGINT AS number, CASE WHEN way = 0 AND c <= 60 THEN o_custkey % 100 END::INT AS extension, CASE WHEN way = 0 AND c <= 60 THEN 'x y' WHEN way = 2 THEN '-' END AS rest FROM o""")
def approval_grammar(t: Tables) -> DataFrame:
    """Type approvals, whole or not, whose country is one of sixty at most, and what else stands in the text."""
    fields = {"country": "int", "directive": "string", "number": "bigint", "extension": "int"}
    read = t.orders.select("o_orderkey", compile_grammar(F.expr(_APPROVAL_TEXT), APPROVAL, fields).alias("g"))
    return read.select("o_orderkey", "g.alternative", *(f"g.{c}" for c in fields), "g.rest")
