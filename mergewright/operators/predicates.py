"""Conditions (field, operator, values) compiled to one column: values are alternatives, conditions hold together.

Fields and operators outside the given lists are refused. not_equals and is_empty include null, not_in doesn't; number
fields compare as numbers, and text that isn't a number never matches a bound. Bounds that are numbers compare text fields
as numbers too; others compare as text. Numbers in text compare exactly (28 digits before the point, ten behind it); between
takes two values, and dates are written as yyyy-mm-dd: anything else is refused when the condition is compiled.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from datetime import date
from decimal import Context, Decimal, InvalidOperation
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import guarded_decimal

OPERATORS = ("equals", "not_equals", "starts_with", "contains", "gte", "lte", "is_empty", "between", "regex", "in", "not_in", "exists", "is_null", "is_not_null", "overlaps")


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    values: tuple = ()


@dataclass(frozen=True)
class Field:
    """kind: text, number, number_text (numbers in a text column), date (or time), or list (an array of text)."""

    column: str
    kind: str = "text"


def compile_condition(c: Condition, fields: Mapping[str, Field]) -> Column:
    if c.field not in fields:
        raise ValueError(f"unknown field {c.field!r}")
    if c.operator not in OPERATORS:
        raise ValueError(f"unknown operator {c.operator!r}")
    field = fields[c.field]
    col = F.col(field.column)
    if c.operator == "is_empty":
        if field.kind == "list":
            return col.isNull() | (F.size(col) == 0)
        return col.isNull() if field.kind in ("number", "date") else col.isNull() | (F.trim(col) == "")
    if c.operator == "is_null":
        return col.isNull()
    if c.operator in ("exists", "is_not_null"):
        return col.isNotNull()
    if not c.values:
        raise ValueError(f"{c.operator} needs values")
    if field.kind == "list" or c.operator == "overlaps":
        if field.kind != "list" or c.operator != "overlaps":
            raise ValueError(f"{c.operator} isn't for fields of kind {field.kind}")
        return F.coalesce(F.arrays_overlap(col, F.array(*map(F.lit, c.values))), F.lit(False))
    if field.kind == "date":
        return _date_condition(c, col.cast("date"))
    if c.operator == "between" and len(c.values) != 2:
        raise ValueError("between needs two values")
    values = [v for v in map(_number if field.kind == "number" else _decimal, c.values) if v is not None]
    bound = c.operator in ("gte", "lte", "between")
    if (field.kind != "text" and (bound or c.operator in ("equals", "in", "not_equals", "not_in"))) or (bound and len(values) == len(c.values)):
        number = col if field.kind == "number" else guarded_decimal(col)
        if not bound:
            hit = number.isin(*values) if values else F.lit(False)
            return hit if c.operator in ("equals", "in") else ~hit if c.operator == "not_in" else number.isNull() | ~hit
        if c.operator == "between":
            return number.between(values[0], values[1]) if len(values) == 2 else F.lit(False)
        tests = [number >= v if c.operator == "gte" else number <= v for v in values]
        return F.coalesce(reduce(or_, tests), F.lit(False)) if tests else F.lit(False)
    text = col.cast("string")
    if c.operator in ("equals", "in"):
        return text.isin(*c.values)
    if c.operator == "not_in":
        return ~text.isin(*c.values)
    if c.operator == "not_equals":
        return text.isNull() | ~text.isin(*c.values)
    tests = {
        "starts_with": text.startswith,
        "contains": text.contains,
        "regex": text.rlike,
        "gte": lambda v: text >= v,
        "lte": lambda v: text <= v,
    }
    if c.operator == "between":
        return text.between(*c.values[:2])
    return reduce(or_, map(tests[c.operator], c.values))


def _date_condition(c: Condition, day: Column) -> Column:
    days = [F.lit(v if isinstance(v, date) else date.fromisoformat(str(v))).cast("date") for v in c.values]
    if c.operator == "between":
        if len(days) != 2:
            raise ValueError("between needs two values")
        return day.between(*days[:2])
    if c.operator in ("gte", "lte"):
        return reduce(or_, (day >= d if c.operator == "gte" else day <= d for d in days))
    if c.operator in ("equals", "in", "not_in", "not_equals"):
        hit = reduce(or_, (day == d for d in days))
        return hit if c.operator in ("equals", "in") else ~hit if c.operator == "not_in" else day.isNull() | ~hit
    raise ValueError(f"{c.operator} isn't for dates")


def _decimal(v) -> Decimal | None:
    """A finite number exactly, to ten places; null where it has more digits than a decimal column holds."""
    try:
        d = Decimal(str(v).strip())
    except InvalidOperation:
        return None
    return d if d.is_finite() and abs(d) < Decimal(10) ** 28 and d == d.quantize(Decimal("1e-10"), context=Context(prec=60)) else None


def _number(v) -> float | int | None:
    """A finite number; whole ones exactly."""
    try:
        d = Decimal(str(v).strip())
    except InvalidOperation:
        return None
    return None if not d.is_finite() else int(d) if d == d.to_integral_value() else float(d)


def compile_filter(conditions: Iterable[Condition], fields: Mapping[str, Field], lifted: str | None = None) -> Column:
    """All conditions, without those on the lifted field."""
    return reduce(and_, (compile_condition(c, fields) for c in conditions if c.field != lifted), F.lit(True))


def search(text: str, columns: list[str]) -> Column:
    """Every word of a search occurs in one of the columns."""
    words = text.split()
    whole = F.concat_ws(" ", *columns)
    return reduce(and_, (F.lower(whole).contains(w.lower()) for w in words), F.lit(True))
