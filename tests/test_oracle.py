"""Every query that has SQL, against DuckDB on the same small tables."""

from __future__ import annotations

import math
import os

import __spark_entry__
import duckdb
import pytest

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        path = f"{FOLDER}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def key(row):
    return tuple((v is None, "" if v is None else repr(v) if not isinstance(v, float) or not math.isnan(v) else "nan") for v in row)


@pytest.mark.parametrize("name", SQL)
def test_oracle(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, FOLDER)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    order = [names.index(c) for c in got.columns]
    assert sorted(map(key, (tuple(r) for r in got.collect()))) == sorted(map(key, (tuple(r[i] for i in order) for r in want.fetchall())))


def test_every_query_has_sql_or_is_tested_otherwise():
    missing = set(__spark_entry__.queries()) - set(SQL)
    assert all(n == "pipeline" or n.startswith("op") for n in missing)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
