"""Grammars as tables: ordered alternatives of patterns, compiled to one typed struct per text without Python.

An alternative has a pattern, and for each of its fields where the value comes from; the first alternative whose pattern
matches, and whose bounds hold, gives the struct: its name, the fields (null where it says nothing of one) and the rest of the
text outside the match. A null text, and one that no alternative reads, gives a null struct.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Take:
    """A value: a constant; or a group of the pattern, as it stands (cast to the field's type), by a table of its texts (other
    texts give `other`), or where it holds one of several words (the first that it does)."""

    group: int | None = None
    constant: object = None
    table: Mapping[str, object] | None = None
    words: Mapping[str, object] | None = None
    other: object = None


@dataclass(frozen=True)
class Alternative:
    """fields: the first source of each that isn't null counts. bounds: (least, most) of fields."""

    name: str
    pattern: str
    fields: Mapping[str, Sequence[Take]] = field(default_factory=dict)
    bounds: Mapping[str, tuple[float, float]] = field(default_factory=dict)


#: Parts the groups of a match; texts that hold it are read a group at a time.
_MARK = "\ue000"


def _groups(text: Column, pattern: str, n: int) -> Column:
    """The groups 1 to n of the pattern's first match, each at its number, by one match."""
    marked = F.regexp_replace(text, pattern, _MARK + "".join(f"${i}{_MARK}" for i in range(1, n + 1)))
    return F.when(F.contains(text, F.lit(_MARK)), F.array(*(F.regexp_extract(text, pattern, i) for i in range(n + 1)))).otherwise(F.split(marked, _MARK))


def _value(groups: Column, take: Take, kind: str) -> Column:
    if take.group is None:
        return F.lit(take.constant).cast(kind)
    got = F.nullif(F.trim(F.get(groups, F.lit(take.group))), F.lit(""))
    if take.table is not None or take.words is not None:
        out = F.lit(take.other).cast(kind)
        for key, v in reversed(list((take.table or take.words).items())):
            test = got == key if take.table is not None else F.contains(got, F.lit(key))
            out = F.when(test, F.lit(v).cast(kind)).otherwise(out)
        return out if take.other is not None else F.when(got.isNotNull(), out)
    return got.try_cast(kind)


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def compile_grammar(text: Column, alternatives: Sequence[Alternative], kinds: Mapping[str, str]) -> Column:
    """The struct (alternative, a field for each of kinds, rest) of a text. kinds: field to type."""
    if unknown := {f for a in alternatives for f in (*a.fields, *a.bounds)} - {*kinds}:
        raise ValueError(f"fields without a type: {sorted(unknown)}")

    def read(a: Alternative, text: Column) -> Column:
        def fields(groups: Column) -> Column:
            values = {f: F.coalesce(*(_value(groups, t, kind) for t in a.fields.get(f, ())), F.lit(None).cast(kind)) for f, kind in kinds.items()}
            within = reduce(and_, (values[f].between(low, high) for f, (low, high) in a.bounds.items()), F.lit(True))
            rest = F.nullif(F.trim(F.regexp_replace(text, a.pattern, " ")), F.lit(""))
            return F.when(within, F.struct(F.lit(a.name).alias("alternative"), *(v.alias(f) for f, v in values.items()), rest.alias("rest")))

        n = max((t.group for takes in a.fields.values() for t in takes if t.group is not None), default=0)
        return F.when(text.rlike(a.pattern), _once(_groups(text, a.pattern, n), fields))

    return _once(text, lambda x: F.coalesce(*(read(a, x) for a in alternatives)))
