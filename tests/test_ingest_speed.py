"""Events become segments without a Spark job for each, and are looked at by columns."""

from __future__ import annotations

import pytest

from tallywell.engine import Engine, EngineConfig
from tallywell.plans.errors import QueryError
from tallywell.streaming.ingest import survey


def test_a_flush_is_one_file_and_no_job(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    db = Engine(spark, EngineConfig(path=path))
    rows = [{"i": 1, "f": 2, "s": "é", "b": True, "m": 1}, {"i": -(2**63), "f": 0.5, "b": None, "m": True}, {"late": "x" * 3_000_000, "none": None}]
    spark.sparkContext.setJobGroup("flush", "flush")
    db.ingest_rows("t", rows)
    db.flush()
    assert not list(spark.sparkContext.statusTracker().getJobIdsForGroup("flush"))
    spark.sparkContext.setJobGroup("others", "others")
    assert len(list((tmp_path / "db/t").rglob("*.parquet"))) == 1 and not [p for p in (tmp_path / "db/_log").rglob("*")]
    again = Engine(spark, EngineConfig(path=path))
    got = again.sql("SELECT i, f, s, b, m, LENGTH(late) AS n, none FROM t").collect()
    want = [(1, 2.0, "é", True, "1", None, None), (-(2**63), 0.5, None, None, "true", None, None), (None, None, None, None, None, 3_000_000, None)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_a_survey_of_rows_is_that_of_each(spark):
    rows = [{"a": 1, "b": "xyz"}, {"a": 2.5}, {"c": None, "a": None}, {}]
    kinds, size = survey(rows)
    assert list(kinds.items()) == [("a", "float"), ("b", "str"), ("c", "null")] and size == sum(survey([r])[1] for r in rows) == 3 * 25 + 20 + 25
    with pytest.raises(QueryError, match="can't hold list"):
        survey([{"a": 1}, {"a": []}])
    db = Engine(spark)
    with pytest.raises(QueryError):
        db.ingest_rows("t", [{"a": 1}, {"a": b""}])
    assert not db.buffer.rows
