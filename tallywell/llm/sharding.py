"""Jump consistent hashing (Lamping and Veach, 2014): keys to shards without a table.

A shard depends on the key and the number of shards only.  With one more shard a
key stays or goes to the new shard, which gets about its share.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, configure

#: Rows, on average, of the groups in which slots are counted.
SLOT_ROWS = 50_000

_MUL, _ONE = np.uint64(2862933555777941757), np.uint64(1)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, from 0, of each 64-bit key.  A key leaves the loop when its next jump
    would pass the last shard, after about ln(shards) rounds on average."""
    if shards < 1:
        raise ValueError("there must be a shard")
    key = keys.astype(np.uint64)
    out = np.zeros(len(key), np.int64)
    todo, at = np.arange(len(key)), np.zeros(len(key), np.int64)
    while len(todo):
        out[todo] = at
        key = key * _MUL + _ONE
        at = np.floor((at + 1) * (2147483648.0 / ((key >> np.uint64(33)) + _ONE).astype(np.float64))).astype(np.int64)
        go = at < shards
        todo, key, at = todo[go], key[go], at[go]
    return out


def shards_of(key: F.Column, shards: int) -> F.Column:
    """A column with the shard of each long key, and the one with a shard more, as fields shard and
    grown_shard; a null key counts as 0."""

    @F.pandas_udf("shard int, grown_shard int")
    def each(keys: pd.Series) -> pd.DataFrame:
        numbers = keys.to_numpy(np.int64).view(np.uint64)
        return pd.DataFrame({"shard": jump(numbers, shards).astype(np.int32), "grown_shard": jump(numbers, shards + 1).astype(np.int32)})

    return each(F.coalesce(key.cast("long"), F.lit(0)))


def assigned(docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, size (UTF-8 bytes of the text and 1),
    text_crc32, law ("key"), shard, slot and grown_shard (with one shard more).

    Slots count a shard's rows from 0 without gaps, within groups of about SLOT_ROWS rows and by id
    there; each group counts its own, and the groups' totals, a small table, are
    summed up, so no shard is gathered in one task.  Groups are dealt by the row's number, so
    rows of one id part.  A null text has size 1 and the checksum of no bytes; rows without an id
    have the shard of id 0.  Equal ids go to one shard.  No rows give no rows.
    """
    configure(docs.sparkSession)
    work = Workspace(docs.sparkSession, "sharding")
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    rows = rows.withColumn("_to", shards_of(F.col("doc_id"), shards)).withColumn("_row", F.monotonically_increasing_id())
    # written, as rows must have the same numbers where they are counted and where they get their slots
    rows = work.save(rows.select("doc_id", "size", "text_crc32", "_to.shard", "_to.grown_shard", "_row"), "rows")
    groups = max(1, rows.count() // SLOT_ROWS)
    rows = rows.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)).cast("int"))
    totals = rows.groupBy("_group", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_group", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("_group", "shard").orderBy("doc_id", "size", "text_crc32", "_row")
    out = rows.withColumn("_at", F.row_number().over(within) - 1).join(totals, ["_group", "shard"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_first") + F.col("_at")).cast("long").alias("slot"), "grown_shard"
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over eight shards."""
    return assigned(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)
