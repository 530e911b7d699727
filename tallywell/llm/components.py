"""Connected components of a graph whose edges are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Rounds after which something must be wrong: each one at least halves the
#: depth of every component's tree, and 2 ** 60 nodes fit in no table.
MOST_ROUNDS = 60


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame, work: Workspace) -> DataFrame:
    """``edges`` has long columns u and v.  Returns one row (node, root) for each node
    from which a smaller one can be reached; root is the smallest of those.

    Alternates the large-star and small-star steps (Kiveris et al., 2014).  Each
    hangs neighbours on the smallest one by an aggregate and an equi-join, so a
    node with very many neighbours is split like any skewed join key, and nothing
    is gathered in a task or in the driver but a row count and a checksum.
    Self-loops and repeated edges are ignored; no edges give no rows; rows with a
    null end are ignored.
    """
    now = work.save(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges0"
    )
    seen = None
    for turn in range(1, MOST_ROUNDS):
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = now.union(now.select("v", "u"))
        least = _least_neighbour(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = _least_neighbour(large)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = work.save(small.union(least.select("u", "m")).distinct(), f"edges{turn}")
        work.drop(f"edges{turn - 1}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
