"""The steps of a query, as DataFrame operations.

Inside a query columns have made-up names, so that names with dots, differing in case
only or occurring twice do no harm; the last step gives the result's names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.typed import BOOL, NULL, SPARK, Typed, kind_of, stored, time_type
from ..plans.errors import QueryTypeError


def scan(df: DataFrame, wanted: Sequence[str]) -> tuple[DataFrame, dict[str, Typed]]:
    """The wanted columns of ``df`` in the dialect's types.  They are taken by position,
    and the others are pruned from the scan."""
    fields = list(df.schema.fields)
    place = {f.name: i for i, f in reversed(list(enumerate(fields)))}
    renamed = df.toDF(*(f"c{i}" for i in range(len(fields))))
    columns: dict[str, Typed] = {}
    chosen: list[Column] = []
    for name in wanted:
        i = place[name]
        column = stored(F.col(f"c{i}"), fields[i].dataType)
        if column is None:
            raise QueryTypeError(f"column {name} has a type that queries can't read: {fields[i].dataType.simpleString()}")
        chosen.append(column.alias(f"c{i}"))
        time = time_type(fields[i].dataType)
        if time:
            chosen.append(F.col(f"c{i}").alias(f"t{i}"))
        columns[name] = Typed(F.col(f"c{i}"), kind_of(fields[i].dataType), time=F.col(f"t{i}") if time else None, time_type=time)
    return renamed.select(*chosen) if chosen else renamed, columns


def keep(df: DataFrame, condition: Typed) -> DataFrame:
    """Rows in which the condition is true; NULL is not."""
    if condition.kind not in (BOOL, NULL):
        raise QueryTypeError(f"WHERE does not take {condition.kind}")
    return df.where(condition.as_(BOOL))


def group(df: DataFrame, keys: Sequence[Typed], aggregates: Sequence[Typed], none_if_empty: bool) -> tuple[DataFrame, list[Typed], list[Typed]]:
    """Partial aggregation, a shuffle by the keys, and the final one.  Without keys there
    is one row, or with ``none_if_empty`` none if there was no row to aggregate."""
    calls = [a.column.alias(f"a{i}") for i, a in enumerate(aggregates)]
    if keys:
        by = [k.column.cast(SPARK[k.kind]).alias(f"k{i}") for i, k in enumerate(keys)]
        out = df.groupBy(*by).agg(*calls) if calls else df.select(*by).distinct()
    else:
        out = df.agg(*calls, F.count(F.lit(1)).alias("rows"))
        out = out.where("rows > 0") if none_if_empty else out
    made = lambda kind, xs: [Typed(F.col(f"{kind}{i}"), x.kind) for i, x in enumerate(xs)]
    return out, made("k", keys), made("a", aggregates)


def sort(df: DataFrame, orders: Sequence[tuple[Typed, bool]]) -> DataFrame:
    """NULL counts as the largest value: last upward, first downward."""
    by = [x.column.desc_nulls_first() if down else x.column.asc_nulls_last() for x, down in orders if x.kind != NULL]
    return df.orderBy(*by) if by else df


def cut(df: DataFrame, limit: int | None, offset: int) -> DataFrame:
    """With a sort below, Spark keeps the first rows of each partition and merges those."""
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def project(df: DataFrame, columns: Sequence[Column], names: Sequence[str]) -> DataFrame:
    return df.select(*(c.alias(f"r{i}") for i, c in enumerate(columns))).toDF(*names)


