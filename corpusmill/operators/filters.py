"""Metadata filters: a nested dictionary compiled to a Column, so that Catalyst pushes it to the scan.

Operators: ``$eq $ne $in $nin $gt $gte $lt $lte $exists`` on a field, ``$and $or $not`` around filters, a
bare value for equality. Missing (null) fields: ``$ne``, ``$nin`` and ``$not`` match, all comparisons don't.
Anything else raises, before a job starts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Field = Callable[[str], Column]


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _values(op: str, value) -> list:
    if isinstance(value, (str, bytes)) or not isinstance(value, Iterable):
        raise ValueError(f"{op} wants a list, not {value!r}")
    return list(value)


# Comparisons stay bare, so that they reach the scan; their null (a missing field) matches nothing in a filter.
_COMPARE: dict[str, Callable[[Column, object], Column]] = {
    "$eq": lambda c, v: (c == v) if v is not None else c.isNull(),
    "$ne": lambda c, v: (c.isNull() | (c != v)) if v is not None else c.isNotNull(),
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(_values("$in", v)),
    "$nin": lambda c, v: c.isNull() | ~c.isin(_values("$nin", v)),
    "$exists": lambda c, v: c.isNotNull() if v else c.isNull(),
}


def compile_filter(spec: Mapping | None, field: Field = F.col) -> Column:
    """The filter as a Column for ``where`` (null counts as no match). ``field`` names a field's column (or map entry)."""
    if not spec:
        return F.lit(True)
    if not isinstance(spec, Mapping):
        raise ValueError(f"a filter is a mapping, not {spec!r}")
    parts = []
    for key, value in spec.items():
        if key in ("$and", "$or"):
            inner = [compile_filter(s, field) for s in _values(key, value)]
            if not inner:
                raise ValueError(f"{key} is empty")
            parts.append(reduce(Column.__and__ if key == "$and" else Column.__or__, inner))
        elif key == "$not":
            parts.append(~_true(compile_filter(value, field)))
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        elif isinstance(value, Mapping):
            for op, operand in value.items():
                if op not in _COMPARE:
                    raise ValueError(f"unknown operator {op}")
                parts.append(_COMPARE[op](field(key), operand))
        else:
            parts.append(_COMPARE["$eq"](field(key), value))
    return reduce(Column.__and__, parts)


def map_field(column: str = "metadata") -> Field:
    """Fields kept in a string map."""
    return lambda name: F.try_element_at(F.col(column), F.lit(name))


def all_of(*filters: Mapping | None) -> Mapping | None:
    """The conjunction of filters, of which any may be missing."""
    given = [f for f in filters if f]
    return {"$and": given} if len(given) > 1 else given[0] if given else None


def candidates(records: DataFrame, spec: Mapping | None = None, surfaces: Iterable[str] | None = None, field: Field = F.col) -> DataFrame:
    """The rows that a search may rank: of these kinds, and matching the filter. Applied before any statistics."""
    out = records.where(compile_filter(spec, field))
    return out if surfaces is None else out.where(F.col("surface_kind").isin(list(surfaces)))
