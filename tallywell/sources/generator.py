"""Synthetic tables: columns of ``spark.range`` whose values depend on seed and row only.

A generator takes the row's number in its partition, the partition's number and the
partition's length, as columns, and gives a column, so rows are made in parallel and
the same whenever they are made again.  A Markov chain depends on the rows before and is
made a partition at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: row in partition, partition, length, salt -> value
Generator = Callable[[Column, Column, int, int], Column]


def _random(row: Column, part: Column, salt: int, draw: int = 0) -> Column:
    """A double in [0, 1) for each row."""
    return F.shiftrightunsigned(F.xxhash64(row, part, F.lit(salt), F.lit(draw)), 11).cast("double") / float(1 << 53)


def _pick(values: Sequence, weights: Sequence[float], u: Column) -> Column:
    total, out, so_far = float(sum(weights)), None, 0.0
    for value, weight in zip(values, weights):
        so_far += weight / total
        out = F.when(u < so_far, F.lit(value)) if out is None else out.when(u < so_far, F.lit(value))
    return out.otherwise(F.lit(values[-1]))


def int_uniform(low: int, high: int) -> Generator:
    """Whole numbers from low to high - 1."""
    return lambda row, part, n, salt: (F.lit(low) + F.floor(_random(row, part, salt) * float(high - low))).cast("long")


def splayed(offset: int, coefficient: int) -> Generator:
    """Numbers in a range that moves on with the partition."""

    def make(row, part, n, salt):
        width = coefficient * n
        return (F.lit(offset) + part * width + F.floor(_random(row, part, salt) * float(width))).cast("long")

    return make


def int_weighted(values: Sequence[int], weights: Sequence[float]) -> Generator:
    return lambda row, part, n, salt: _pick(values, weights, _random(row, part, salt)).cast("long")


def nullable_ints(values: Sequence[int | None], weights: Sequence[float]) -> Generator:
    return int_weighted(values, weights)


def string_weighted(values: Sequence[str], weights: Sequence[float]) -> Generator:
    return lambda row, part, n, salt: _pick(values, weights, _random(row, part, salt))


def incrementing_int() -> Generator:
    return lambda row, part, n, salt: (part * n + row).cast("long")


def random_hex_string(length: int) -> Generator:
    """``length`` bytes in hexadecimal digits."""
    draws = -(-length // 8)

    def make(row, part, n, salt):
        words = [F.lpad(F.hex(F.xxhash64(row, part, F.lit(salt), F.lit(d))), 16, "0") for d in range(draws)]
        return F.lower(F.substring(F.concat(*words), 1, 2 * length))

    return make


def random_string(least: int, most: int) -> Generator:
    """Letters and digits."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def make(row, part, n, salt):
        size = F.lit(least) + F.floor(_random(row, part, salt, -1) * float(most - least + 1))
        chars = [F.substr(F.lit(letters), F.floor(_random(row, part, salt, d) * 62.0).cast("int") + 1, F.lit(1)) for d in range(most)]
        return F.substr(F.concat(*chars), F.lit(1), size.cast("int"))

    return make


def partition_sparse(null_probability: float, inner: Generator) -> Generator:
    """NULL in some partitions as a whole."""
    return lambda row, part, n, salt: F.when(_random(F.lit(-1), part, salt, -2) >= null_probability, inner(row, part, n, salt))


@dataclass(frozen=True)
class Markov:
    """A chain over ``values``; ``transitions`` has a row of weights for each of them."""

    values: tuple
    transitions: tuple[tuple[float, ...], ...]


def int_markov_chain(values: Sequence[int], transitions: Sequence[Sequence[float]]) -> Markov:
    return Markov(tuple(values), tuple(map(tuple, transitions)))


def string_markov_chain(values: Sequence[str], transitions: Sequence[Sequence[float]]) -> Markov:
    return Markov(tuple(values), tuple(map(tuple, transitions)))


def generate(spark: SparkSession, columns: Mapping[str, Generator | Markov], partitions: int, partition_size: int, seed: int = 0) -> DataFrame:
    """``partitions`` times ``partition_size`` rows."""
    rows = spark.range(0, partitions * partition_size, 1, partitions)
    part, row = F.floor(F.col("id") / partition_size).cast("long"), (F.col("id") % partition_size).cast("long")
    chains = {f"m{i}": g for i, g in enumerate(columns.values()) if isinstance(g, Markov)}
    base = rows.select(part.alias("part"), row.alias("row"))
    if chains:
        kinds = {k: "long" if isinstance(g.values[0], int) else "string" for k, g in chains.items()}

        plain = [(k, g.values, g.transitions) for k, g in chains.items()]

        def chained(batches):  # uses nothing of this package, which executors may not have
            for batch in batches:
                for p in batch["part"]:
                    made = {"part": p, "row": np.arange(partition_size)}
                    for i, (k, values, transitions) in enumerate(plain):
                        rng = np.random.default_rng([seed, int(p), i])
                        sums = np.cumsum(np.array(transitions, float), axis=1)
                        sums /= sums[:, -1:]
                        state, out = int(rng.integers(len(values))), []
                        for u in rng.random(partition_size):
                            state = min(int(np.searchsorted(sums[state], u, "right")), len(values) - 1)
                            out.append(values[state])
                        made[k] = out
                    yield pd.DataFrame(made)

        schema = "part long, row long, " + ", ".join(f"{k} {v}" for k, v in kinds.items())
        base = spark.range(0, partitions, 1, partitions).toDF("part").mapInPandas(chained, schema)
    made = [F.col(f"m{i}") if isinstance(g, Markov) else g(F.col("row"), F.col("part"), partition_size, seed * 1000 + i) for i, g in enumerate(columns.values())]
    return base.select(*(c.alias(f"c{i}") for i, c in enumerate(made))).toDF(*columns)
