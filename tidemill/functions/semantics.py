"""PostgreSQL-compatible semantics as Column expressions: null order, exact sums, overlap, structured filters."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pg_asc(c: str | Column) -> Column:
    """Ascending with nulls last."""
    return col(c).asc_nulls_last()


def pg_desc(c: str | Column) -> Column:
    """Descending with nulls first."""
    return col(c).desc_nulls_first()


def sum_exact(c: str | Column) -> Column:
    """Sum of 64-bit integers without overflow, as decimal(38,0)."""
    return F.sum(col(c).cast("decimal(38,0)"))


def avg_exact(c: str | Column) -> Column:
    """Average of integers as a decimal; null over no rows."""
    return F.try_divide(sum_exact(c), F.count(col(c)).cast("decimal(20,0)"))


def overlaps(a: str | Column, b: str | Column) -> Column:
    """Whether two arrays share an element; empty arrays and null elements never do."""
    return F.coalesce(F.arrays_overlap(F.array_compact(col(a)), F.array_compact(col(b))), F.lit(False))


def round_half_even(c: str | Column, scale: int = 0) -> Column:
    """Rounding of doubles to the even neighbour at ties."""
    return F.bround(col(c), scale)


def trunc_number(c: str | Column, scale: int = 0) -> Column:
    """Truncation of numbers toward zero."""
    f = F.lit(10.0**scale)
    return F.when(col(c) < 0, F.ceil(col(c) * f)).otherwise(F.floor(col(c) * f)) / f


def bpchar_equal(a: str | Column, b: str | Column) -> Column:
    """Equality of blank-padded strings."""
    return F.rtrim(col(a)) == F.rtrim(col(b))


class InvalidParameter(ValueError):
    """A parameter value the operator rejects (SQLSTATE 22023)."""


OPERATORS = {"=": lambda c, v: c == v, "<": lambda c, v: c < v, ">": lambda c, v: c > v, "<=": lambda c, v: c <= v, ">=": lambda c, v: c >= v, "<>": lambda c, v: c != v}


def structured_filter(conditions: list[dict[str, Any]]) -> Column:
    """The conjunction of ``{col, op, value}`` conditions; op is one of = < > <= >= <> IN &&. No condition is true."""
    if not isinstance(conditions, list):
        raise InvalidParameter("the filter must be an array")
    out = F.lit(True)
    for c in conditions:
        if not isinstance(c, dict) or not {"col", "op", "value"} <= c.keys() or not isinstance(c["col"], str):
            raise InvalidParameter(f"a condition needs col, op and value: {c!r}")
        op, value = str(c["op"]).upper(), c["value"]
        if op in ("IN", "&&"):
            if not isinstance(value, list) or not value:
                raise InvalidParameter(f"{op} needs a non-empty array")
            out &= F.col(c["col"]).isin(value) if op == "IN" else overlaps(c["col"], F.array(*map(F.lit, value)))
        elif op in OPERATORS:
            if value is None or isinstance(value, (list, dict)):
                raise InvalidParameter(f"{op} needs a string, number or boolean")
            out &= OPERATORS[op](F.col(c["col"]), F.lit(value))
        else:
            raise InvalidParameter(f"unknown operator {c['op']!r}")
    return out


def raw_filter(predicate: str) -> Column:
    """One boolean SQL predicate; statement separators and comments are rejected."""
    if re.search(r";|--|/\*|\*/", predicate):
        raise InvalidParameter("the filter must be a single predicate without comments")
    return F.expr(predicate)
