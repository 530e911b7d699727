"""What is broadcast where Spark sizes a table too low."""

from __future__ import annotations

import random

from tallywell.llm import common, copies, simhash

from .fixtures import table


def test_cells_are_not_broadcast(spark):
    """A fingerprint has 33 cells, and Spark counts them as one: neither side of their join may go by that."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    rng = random.Random(4)
    prints = [rng.getrandbits(64) - (1 << 63) for _ in range(300)]
    prints += [p ^ 3 for p in prints[:100]]
    found = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long").repartition(2, "fp"))
    assert {frozenset(r) for r in found.collect()} >= {frozenset((p, p ^ 3)) for p in prints[:100]}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_the_near_copy_stage_broadcasts_no_cells_or_keys(spark, monkeypatch):
    """What is as large as the texts' numbers, keys or cells is joined by shuffling, however small its files are."""
    plans: dict[str, str] = {}
    save = common.Workspace.save

    def kept(self, df, name):
        plans[name] = plans.get(name, "") + df._jdf.queryExecution().executedPlan().toString()
        return save(self, df, name)

    monkeypatch.setattr(common.Workspace, "save", kept)
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (2, f"{text} more"), (3, "something else in so many words"), (4, text)]
    found, groups = copies.near_copies(table(spark, rows))
    got = {r.doc_id: r._group for r in found.select("_row", "doc_id").join(groups, "_row").collect()}
    assert got[1] == got[2] == got[4] != got[3]
    for name in ("keys", "prints"):
        assert "SortMergeJoin" in plans[name] and "Broadcast" not in plans[name]
    assert "SortMergeJoin" in plans["edges0"]
