"""Approximate nearest neighbours by randomly rotated one-bit codes (after RaBitQ,
Gao and Long, 2024).

A vector's residual to a centroid is scaled to length one, padded with zeros to
``BITS_EACH`` times its dimensions, turned by a random orthogonal matrix and kept as the
signs of its coordinates: its code, packed into words of 64 bits, with its length and its
inner product with the code's own direction as correction scalars.  A query is turned
likewise and its coordinates rounded to ``PLANES`` bits, so that its inner product with a
code is a sum of popcounts of the code and each bit plane.  Divided by the code's scalar, it
estimates the one with the vector without bias, and the scalars and the rounding give the
width of a confidence interval.

Blocks of codes and blocks of queries meet in a grid of shards, both of bounded size, by an
equi-join.  A pair of blocks measures exactly the vectors whose least possible distance is within
the query's threshold: the least of the k-th greatest possible distance in the block and the
k-th distance in a bounded sample of the rows, which is computed once with the query.  Each
pair gives the k nearest for each of its queries.  Vectors travel with their codes: one pair in
eight is measured, and fetching these by a join would move more.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import configure, tidy

#: Rows of a block of vectors and of a block of queries.
BLOCK_ROWS, QUERY_ROWS = 8192, 512
#: Bytes of codes and of queries in a shard of the grid, on average at most.
SHARD_BYTES = 64 << 20
#: Rows to which the centroid and the first thresholds are fitted, at most.
SAMPLE_ROWS = 4096
#: Half-width of the confidence interval in standard errors: at 4 about one vector in
#: sixteen thousand lies outside of it.
ERRORS = 4.0
#: One-bit codes of a vector, as times its dimensions, and bits of a query's coordinates.
BITS_EACH, PLANES = 4, 4


@dataclass(frozen=True)
class Model:
    """What codes are made with: a centroid, an orthogonal matrix, and sampled rows."""

    centre: np.ndarray
    turn: np.ndarray  # [dimension, bits]: the rows of an orthogonal matrix that padding leaves
    sample_ids: np.ndarray
    sample: np.ndarray

    @property
    def bits(self) -> int:
        return self.turn.shape[1]


def fit(ids: np.ndarray, sample: np.ndarray, bits_each: int = BITS_EACH, seed: int = 7) -> Model:
    d = sample.shape[1]
    bits = -(-d * bits_each // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return Model(sample.mean(axis=0), (q * np.sign(np.diag(r)))[:d].copy(), ids, sample)


def encode(model: Model, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, the residuals' lengths, and each code's inner product with its
    residual's direction (1 where the residual is zero)."""
    residual = vectors - model.centre
    length = np.sqrt((residual**2).sum(axis=1))
    turned = residual @ model.turn
    signs = turned > 0
    inner = np.abs(turned).sum(axis=1) / np.sqrt(model.bits) / np.where(length > 0, length, 1)
    return np.packbits(signs, axis=1), length, np.where(length > 0, inner, 1.0)


@dataclass(frozen=True)
class Queries:
    """Queries as they meet codes: lengths of residuals, the coordinates' least value and step,
    their bit planes, and the sums of the rounded coordinates."""

    own: np.ndarray
    least: np.ndarray
    step: np.ndarray
    planes: np.ndarray  # [query, plane, word]
    total: np.ndarray

    @staticmethod
    def of(model: Model, queries: np.ndarray) -> Queries:
        residual = queries - model.centre
        turned = residual @ model.turn
        least = turned.min(axis=1)
        step = (turned.max(axis=1) - least) / ((1 << PLANES) - 1)
        level = np.rint((turned - least[:, None]) / np.where(step > 0, step, 1)[:, None]).astype(np.uint8)
        planes = np.packbits((level[:, None, :] >> np.arange(PLANES, dtype=np.uint8)[:, None]) & 1, axis=2)
        total = model.bits * least + step * level.sum(axis=1, dtype=np.int64)
        return Queries(np.sqrt((residual**2).sum(axis=1)), least, step, np.ascontiguousarray(planes).view(np.uint64), total)


def _bounds(bits: int, codes: np.ndarray, ones: np.ndarray, length: np.ndarray, inner: np.ndarray, queries: Queries, i: int, errors: float) -> tuple[np.ndarray, np.ndarray]:
    """[vector]: the least and the greatest squared distance from query i that the codes allow.
    ``codes`` are words, ``ones`` the number of ones in each code."""
    own, least, step = queries.own[i], queries.least[i], queries.step[i]
    shared = np.zeros(len(codes), np.int64)
    for p in range(PLANES):
        shared += np.bitwise_count(codes & queries.planes[i, p]).sum(axis=1, dtype=np.int64) << p
    # the code's direction is (2 * sign - 1) / sqrt(bits)
    product = (2 * (least * ones + step * shared) - queries.total[i]) / np.sqrt(bits)
    scale = length / inner
    # of the code, and of rounding: coordinates are off by up to half a step, evenly
    error = np.sqrt(np.maximum(1 - inner**2, 0) * own**2 / (bits - 1) + step**2 / 12)
    off = errors * error * scale + 1e-9 * (own**2 + length**2)
    middle = own**2 + length**2 - 2 * product * scale
    return middle - 2 * off, middle + 2 * off


def bounds(model: Model, codes: np.ndarray, length: np.ndarray, inner: np.ndarray, queries: np.ndarray, errors: float) -> tuple[np.ndarray, np.ndarray]:
    """[query, vector]: the least and the greatest squared distance that the codes allow."""
    words = np.ascontiguousarray(codes).view(np.uint64)
    ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
    asked = Queries.of(model, queries)
    got = [_bounds(model.bits, words, ones, length, inner, asked, i, errors) for i in range(len(queries))]
    low, high = zip(*got)
    return np.array(low), np.array(high)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, summed in the order of the dimensions."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += (a[:, j] - b[:, j]) ** 2
    return np.sqrt(out)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part: v as doubles, neither null, empty, all
    zero, nor with a null or non-finite component.  Rows without an id take no part."""
    v = F.col(vector_col).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _packed(rows: DataFrame, each_rows: int, columns: int, pack) -> DataFrame:
    """Blocks (block, data0, data1, ...) of up to ``each_rows`` rows: ``pack`` makes arrays of ids and
    vectors; block is a hash of the ids."""
    names = [f"data{i}" for i in range(columns)]

    def each(batches):
        ids, held, n = [], [], 0

        def made():
            data = [np.ascontiguousarray(x).tobytes() for x in pack(np.concatenate(ids), np.concatenate(held))]
            block = int.from_bytes(np.concatenate(ids)[:8].tobytes()[:8], "little") * 0x9E3779B97F4A7C15 >> 20 & (1 << 31) - 1
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([x], pa.binary()) for x in data)], ["block", *names])

        for batch in batches:
            at = 0
            while at < len(batch):
                part = batch.slice(at, each_rows - n)
                ids.append(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
                held.append(_matrix(part.column(1)).astype(np.float64))
                at, n = at + len(part), n + len(part)
                if n == each_rows:
                    yield made()
                    ids, held, n = [], [], 0
        if n:
            yield made()
        tidy()

    return rows.mapInArrow(each, "block int" + "".join(f", {c} binary" for c in names))


def search(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    errors: float = ERRORS,
    bits_each: int = BITS_EACH,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k nearest rows of
    ``vectors`` with another id, nearest first and ties to the smaller id; score is
    the Euclidean distance in double precision.

    Rows that ``usable`` leaves out take no part.  Vectors are compared with those of their
    length only; each length is searched by itself.  Fewer than k candidates give
    fewer rows; no queries or no vectors give none.  Each pair of rows counts, so repeated
    ids give repeated rows, of which the k nearest of a query's id stay.
    """
    spark = vectors.sparkSession
    configure(spark)
    good, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    wanted = {r.size for r in asked.select(F.size("v").alias("size")).distinct().collect()}  # lengths, not rows
    for size, n in sorted(map(tuple, good.groupBy(F.size("v").alias("size")).count().collect())):
        if size in wanted:
            out = out.union(_search(good.where(F.size("v") == size), asked.where(F.size("v") == size), size, n, k, errors, bits_each, sample_rows))
    return out


def _search(good: DataFrame, asked: DataFrame, size: int, rows: int, k: int, errors: float, bits_each: int, sample_rows: int) -> DataFrame:
    """``search`` among vectors of one length."""
    spark = good.sparkSession
    share = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample_rows / rows)) + 1
    sample = good.where(share).limit(2 * sample_rows).collect() or good.limit(sample_rows).collect()
    sample = sorted(sample, key=lambda r: (r.vec_id, r.v))[:sample_rows]
    model = fit(np.array([r.vec_id for r in sample]), np.array([r.v for r in sample]), bits_each)
    fitted = spark.sparkContext.broadcast(model)  # sample_rows vectors and a matrix, whatever the input
    bits, words = model.bits, model.bits // 64

    def coded(ids, v):
        return ids, *encode(fitted.value, v), v

    def turned(ids, v):
        model = fitted.value
        limit = np.full(len(ids), np.inf)
        if len(model.sample_ids) > k:
            for i in range(len(ids)):
                d = ((model.sample - v[i]) ** 2).sum(axis=1)
                d[model.sample_ids == ids[i]] = np.inf
                limit[i] = np.partition(d, k - 1)[k - 1]
        q = Queries.of(model, v)
        return ids, limit, q.own, q.least, q.step, q.planes, q.total, v

    # shards of the grid: as many of codes as keep all cores busy, and of either as its size asks for
    code_bytes, query_bytes = bits // 8 + 24 + 8 * size, bits // 8 * PLANES + 48 + 8 * size
    number = asked.count()
    blocks = -(-rows // BLOCK_ROWS)
    rows_of = max(1, min(blocks, max(4 * spark.sparkContext.defaultParallelism, -(-rows * code_bytes // SHARD_BYTES))))
    columns_of = max(1, -(-number * query_bytes // SHARD_BYTES))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = _packed(good, BLOCK_ROWS, 5, coded).withColumn("down", F.pmod("block", F.lit(rows_of))).withColumn("across", spread(columns_of)).drop("block")
    parts = max(1, min(4 * spark.sparkContext.defaultParallelism, number // QUERY_ROWS))
    right = _packed(asked.repartition(parts, "vec_id"), QUERY_ROWS, 8, turned).withColumn("across", F.pmod("block", F.lit(columns_of))).withColumn("down", spread(rows_of))
    right = right.drop("block").withColumnsRenamed({f"data{i}": f"query{i}" for i in range(8)})

    def each(batches):
        for batch in batches:
            for row in zip(*(batch.column(f"data{i}") for i in range(5)), *(batch.column(f"query{i}") for i in range(8))):
                data = [x.as_buffer() for x in row]
                kinds = np.int64, np.uint64, *[np.float64] * 3, np.int64, *[np.float64] * 4, np.uint64, *[np.float64] * 2
                ids, codes, length, inner, v, query_ids, limit, own, least, step, planes, total, q = (np.frombuffer(x, t) for x, t in zip(data, kinds))
                codes, v, q = codes.reshape(-1, words), v.reshape(-1, size), q.reshape(-1, size)
                ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
                asked = Queries(own, least, step, planes.reshape(-1, PLANES, words), total)
                out = []
                for i, query_id in enumerate(query_ids.tolist()):
                    low, high = _bounds(bits, codes, ones, length, inner, asked, i, errors)
                    high[ids == query_id] = np.inf
                    cut = limit[i] * (1 + 1e-9)
                    if len(ids) > k:
                        cut = min(cut, np.partition(high, k - 1)[k - 1])
                    at = np.flatnonzero((low <= cut) & (ids != query_id))
                    score = distances(v[at], np.broadcast_to(q[i], (len(at), size)))
                    best = np.lexsort((ids[at], score))[:k]
                    out.append((np.full(len(best), query_id), ids[at][best], score[best]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "vec_id", "score"])
        tidy()

    met = left.join(right.hint("merge"), ["down", "across"]).drop("down", "across")
    chosen = met.mapInArrow(each, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return chosen.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every hundredth vector."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, rows.where("vec_id % 100 = 0"))


#: The exact answer; the codes' intervals are wide enough to find it.
OP2_SQL = """
WITH e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, e.vec_id, sqrt(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - e.v[i]) * (q.v[i] - e.v[i])))) AS score FROM e AS q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
