"""Sorted output to its end, in order, against DuckDB."""

from __future__ import annotations

import __spark_entry__
import duckdb
import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["order_multi_all", "order_expr_all", "order_nulls_asc_all", "order_nulls_desc_all"])
def test_all_rows_come_in_order(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    got = [tuple(r) for r in __spark_entry__.queries()[name](spark, FOLDER).collect()]
    assert got == con.execute(__spark_entry__.oracle_sql()[name]).fetchall()
    if "nulls" in name:
        assert len({r[0] is None for r in got}) == 2
