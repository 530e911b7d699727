"""Columns with the types of the dialect."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.errors import QueryTypeError

INT, FLOAT, STR, BOOL, NULL = "int", "float", "str", "bool", "null"
SPARK = {INT: "long", FLOAT: "double", STR: "string", BOOL: "boolean", NULL: "string"}


@dataclass(frozen=True)
class Typed:
    """A column and its kind.  The kind null has the value NULL in every row.

    ``value`` is that of a constant integer.  ``time`` is the column as it is stored where that
    is a date or a time, of type ``time_type``: compared as it is, a scan can skip by it."""

    column: Column
    kind: str
    value: int | None = None
    time: Column | None = None
    time_type: str = ""

    def as_(self, kind: str) -> Column:
        if self.kind == NULL:
            return F.lit(None).cast(SPARK[kind])
        return self.column if self.kind == kind else self.column.cast(SPARK[kind])


def null() -> Typed:
    return Typed(F.lit(None).cast("string"), NULL)


def kind_of(kind: T.DataType) -> str | None:
    """The dialect's type of a Spark type, or None if it has none."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        return INT
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return FLOAT
    return {T.StringType: STR, T.BooleanType: BOOL, T.NullType: NULL}.get(type(kind))


def stored(column: Column, kind: T.DataType) -> Column | None:
    """A stored column in the dialect's type: integers as 64 bits, dates and times as
    seconds since 1970 in UTC.  None for types it does not know."""
    if isinstance(kind, T.TimestampType):
        return F.unix_seconds(column)
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        return F.unix_seconds(column.cast("timestamp"))
    known = kind_of(kind)
    return None if known is None else column.cast(SPARK[known])


def time_type(kind: T.DataType) -> str:
    """Spark's name of a type of dates or times, and nothing for others."""
    return kind.simpleString() if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else ""


def numbers(what: str, *args: Typed) -> str:
    """The kind in which numbers of these kinds are combined."""
    for a in args:
        if a.kind not in (INT, FLOAT, NULL):
            raise QueryTypeError(f"{what} does not take {a.kind}")
    kinds = {a.kind for a in args}
    return FLOAT if FLOAT in kinds else INT if INT in kinds else NULL


def common(what: str, *args: Typed) -> str:
    """The kind to which values of these kinds can be brought."""
    kinds = {a.kind for a in args} - {NULL}
    if kinds <= {INT, FLOAT}:
        return FLOAT if FLOAT in kinds else INT if kinds else NULL
    if len(kinds) == 1:
        return kinds.pop()
    raise QueryTypeError(f"{what} does not take {' and '.join(sorted(kinds))}")
