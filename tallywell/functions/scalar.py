"""Operators and scalar functions: each takes typed columns and returns one.

All are built-in Spark expressions, so they stay within generated code and can be
pushed to the scan.  NULL in gives NULL out, and Boolean operators follow SQL.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.errors import QueryTypeError
from .typed import BOOL, FLOAT, INT, NULL, SPARK, STR, Typed, common, null, numbers


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    """Integers are checked, and their quotient is truncated; with a float on either side
    the result is a float."""
    kind = numbers(op, a, b)
    if NULL in (a.kind, b.kind):
        return Typed(F.lit(None).cast(SPARK[kind if kind != NULL else INT]), kind if kind != NULL else INT)
    x, y = a.as_(kind), b.as_(kind)
    if op == "/":
        return Typed(F.call_function("div", x, y) if kind == INT else x / y, kind)
    return Typed({"+": x.__add__, "-": x.__sub__, "*": x.__mul__, "%": x.__mod__}[op](y), kind)


#: The comparison with its sides exchanged.
_TURNED = {"=": "=", "<>": "<>", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
#: Seconds since 1970 that dates and times of all types can hold.
_FIRST, _LAST = -62_000_000_000, 250_000_000_000


def _with_time(op: str, a: Typed, seconds: int) -> Column | None:
    """The comparison of a stored date or time, taken as whole seconds, with a constant: on the
    column as it is stored, so it can be pushed to the scan and skip files and row groups."""
    if not _FIRST < seconds < _LAST:
        return None
    at = lambda s: F.timestamp_seconds(F.lit(s)).cast(a.time_type)
    if a.time_type == "date":  # each day begins at its first second
        if seconds % 86400:
            op = {"<": "<=", ">=": ">"}.get(op, op)
            if op in ("=", "<>"):
                return None
        day = at(seconds - seconds % 86400)
        return {"=": a.time == day, "<>": a.time != day, "<": a.time < day, "<=": a.time <= day, ">": a.time > day, ">=": a.time >= day}[op]
    begin, end = at(seconds), at(seconds + 1)
    match op:
        case "=":
            return (a.time >= begin) & (a.time < end)
        case "<>":
            return (a.time < begin) | (a.time >= end)
        case "<":
            return a.time < begin
        case "<=":
            return a.time < end
        case ">":
            return a.time >= end
        case _:
            return a.time >= begin


def comparison(op: str, a: Typed, b: Typed) -> Typed:
    if b.time is not None and a.value is not None:
        op, a, b = _TURNED[op], b, a
    if a.time is not None and b.value is not None and (got := _with_time(op, a, b.value)) is not None:
        return Typed(got, BOOL)
    kind = common(op, a, b)
    if NULL in (a.kind, b.kind):
        return Typed(F.lit(None).cast("boolean"), BOOL)
    x, y = a.as_(kind), b.as_(kind)
    return Typed({"=": x.__eq__, "<>": x.__ne__, "<": x.__lt__, "<=": x.__le__, ">": x.__gt__, ">=": x.__ge__}[op](y), BOOL)


def logical(op: str, a: Typed, b: Typed) -> Typed:
    for x in (a, b):
        if x.kind not in (BOOL, NULL):
            raise QueryTypeError(f"{op} does not take {x.kind}")
    x, y = a.as_(BOOL), b.as_(BOOL)
    return Typed(x & y if op == "AND" else x | y, BOOL)


def negation(a: Typed) -> Typed:
    if a.kind not in (BOOL, NULL):
        raise QueryTypeError(f"NOT does not take {a.kind}")
    return Typed(~a.as_(BOOL), BOOL)


def minus(a: Typed) -> Typed:
    kind = numbers("-", a)
    return null() if kind == NULL else Typed(-a.as_(kind), kind)


def is_null(a: Typed, negated: bool) -> Typed:
    return Typed(a.column.isNotNull() if negated else a.column.isNull(), BOOL)


def like(a: Typed, pattern: str, negated: bool) -> Typed:
    """% stands for any characters and _ for one."""
    text = _text("LIKE", a).like(pattern.replace("\\", "\\\\"))
    return Typed(~text if negated else text, BOOL)


def regex(a: Typed, pattern: str) -> Typed:
    """Whether the pattern is found anywhere in the text."""
    return Typed(_text("REGEX", a).rlike(pattern), BOOL)


def floor(a: Typed) -> Typed:
    kind = numbers("FLOOR", a)
    return Typed(F.floor(a.column), INT) if kind == FLOAT else Typed(a.as_(INT), INT)


def to_year(a: Typed) -> Typed:
    """The year, in UTC, of seconds since 1970."""
    if a.kind not in (INT, NULL):
        raise QueryTypeError(f"TO_YEAR does not take {a.kind}")
    return Typed(F.year(F.timestamp_seconds(a.as_(INT))).cast("long"), INT)


def length(a: Typed) -> Typed:
    """Bytes in UTF-8."""
    return Typed(F.octet_length(_text("LENGTH", a)).cast("long"), INT)


def cast(a: Typed, to: str) -> Typed:
    kind = {"INT": INT, "INTEGER": INT, "BIGINT": INT, "LONG": INT, "FLOAT": FLOAT, "DOUBLE": FLOAT, "STRING": STR, "VARCHAR": STR, "TEXT": STR, "BOOLEAN": BOOL}.get(to)
    if kind is None:
        raise QueryTypeError(f"there is no type {to}")
    return Typed(a.as_(kind), kind)


def _text(what: str, a: Typed):
    if a.kind not in (STR, NULL):
        raise QueryTypeError(f"{what} does not take {a.kind}")
    return a.as_(STR)


def checked_pattern(pattern: str) -> str:
    """``pattern``, if it can be a regular expression.  Java's, which run it, have some
    syntax more; what neither knows fails here and not in a task."""
    from pyspark.sql import SparkSession

    session = SparkSession.getActiveSession()
    try:
        if session is not None and hasattr(session, "_jvm"):
            session._jvm.java.util.regex.Pattern.compile(pattern)
        else:
            re.compile(pattern)
    except Exception as e:
        raise QueryTypeError(f"{pattern!r} is no regular expression") from e
    return pattern


#: Functions of one argument by name.
ONE: dict[str, Callable[[Typed], Typed]] = {"floor": floor, "to_year": to_year, "length": length}
