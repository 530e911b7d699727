"""Spark sessions with the settings that the engine's semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Checked arithmetic, UTC, exact names, and plans that adapt at run time.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A session in this process, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tallywell")
    builder = builder.config(map=SETTINGS).config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", memory).config("spark.ui.enabled", "false")
    return builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
