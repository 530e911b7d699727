"""From a query to a DataFrame.

What is built is declarative: one scan of the columns used, filter, partial and final
aggregation, sort with limit, projection.  Catalyst pushes filters to the scan,
prunes columns, folds constants and picks the physical operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import relational
from ..operators.expressions import Compiler, shown
from .analyzer import analyze, constant
from .ast import Query, bare


def build(query: Query, table: DataFrame, compat: str = "sql", sorted_groups: bool = True) -> DataFrame:
    """``query`` over ``table``.

    With ``compat`` "sql" a global aggregate of no rows is one row and a count of
    nothing is 0; with "store" they are no row and NULL.  Groups come out sorted by
    their keys unless the query sorts; ``sorted_groups`` off leaves that out where
    there is no limit, which saves a shuffle of the result.
    """
    plan = analyze(query, table.columns)
    query = plan.query
    df, columns = relational.scan(table, plan.columns)
    compiler = Compiler(columns, strict_counts=compat == "store")
    if query.where is not None:
        df = relational.keep(df, compiler(query.where))
    if plan.grouped:
        keys, aggregates = [compiler(k) for k in plan.keys], [compiler(a) for a in plan.aggregates]
        df, keys, aggregates = relational.group(df, keys, aggregates, compat == "store")
        compiler = Compiler({}, {**dict(zip(plan.keys, keys)), **dict(zip(plan.aggregates, aggregates))})
        if query.having is not None:
            df = relational.keep(df, compiler(query.having))
    results = [compiler(i.expr) for i in query.select]
    orders = [(compiler(o.expr), o.descending) for o in query.order_by if not constant(o.expr)]
    if query.distinct:
        df = df.select(*(shown(r).alias(f"d{i}") for i, r in enumerate(results))).distinct()
        place = {bare(i.expr): k for k, i in reversed(list(enumerate(query.select)))}
        kept = [type(r)(df[f"d{i}"], r.kind) for i, r in enumerate(results)]
        orders = [(kept[place[bare(o.expr)]], o.descending) for o in query.order_by if not constant(o.expr)]
        results = kept
    if plan.grouped and not query.order_by and not query.distinct and (sorted_groups or query.limit is not None or query.offset):
        orders = [(k, False) for k in keys]
    if query.limit == 0:
        df = df.limit(0)
    else:
        df = relational.cut(relational.sort(df, orders), query.limit, query.offset)
    return relational.project(df, [shown(r) for r in results], plan.names)
