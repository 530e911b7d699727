"""Aggregates: each takes a typed column and returns one for ``groupBy().agg()``.

All have a partial form, so rows are aggregated before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..plans.errors import QueryTypeError
from .typed import BOOL, FLOAT, INT, NULL, Typed, numbers

NAMES = ("count", "sum", "min", "max", "avg")


def count(a: Typed, strict: bool) -> Typed:
    """Rows in which the argument is not NULL.  ``strict`` makes a count of none NULL."""
    n = F.count(a.column)
    return Typed(F.nullif(n, F.lit(0).cast("long")) if strict else n, INT)


def total(a: Typed, strict: bool) -> Typed:
    """The sum, of integers checked."""
    kind = numbers("SUM", a)
    return Typed(F.sum(a.as_(FLOAT if kind == NULL else kind)), FLOAT if kind == NULL else kind)


def least(a: Typed, strict: bool) -> Typed:
    return _extreme(F.min, a)


def greatest(a: Typed, strict: bool) -> Typed:
    return _extreme(F.max, a)


def average(a: Typed, strict: bool) -> Typed:
    """Of integers the quotient of sum and count, truncated like any of integers."""
    kind = numbers("AVG", a)
    if kind != INT:
        return Typed(F.avg(a.as_(FLOAT)), FLOAT)
    x = a.as_(INT)
    return Typed(F.call_function("div", F.sum(x), F.nullif(F.count(x), F.lit(0).cast("long"))), INT)


def _extreme(f: Callable, a: Typed) -> Typed:
    if a.kind == BOOL:
        raise QueryTypeError("MIN and MAX do not take bool")
    kind = FLOAT if a.kind == NULL else a.kind
    return Typed(f(a.as_(kind)), kind)


AGGREGATES: dict[str, Callable[[Typed, bool], Typed]] = {"count": count, "sum": total, "min": least, "max": greatest, "avg": average}


def distinct(name: str, a: Typed) -> Typed:
    if name != "count":
        raise QueryTypeError("DISTINCT is for COUNT")
    return Typed(F.count_distinct(a.column), INT)
