"""SimHash near-duplicates by segment popcounts.

A 64-bit fingerprint is mapped to the vector of its bit counts in ``segments``
equal segments.  Flipping a bit moves that vector by one step along one axis, so
the Manhattan distance of two vectors is a lower bound of the Hamming distance of
the fingerprints, and fingerprints at Hamming distance 2 or less have vectors at
Manhattan distance 2 or less.  Two such grid points have a point at distance at
most 1 from both: each fingerprint is put into its own grid cell and those one
step away (2 * segments + 1 rows), which turns the range-join into grouping by
cell, and the groups are then verified exactly.

Only distinct fingerprints take part, so thousands of exact copies count as one.
A cell of up to ``crowd`` fingerprints compares its pairs.  A larger one is refined: its
fingerprints are put into the cells of the finest grid that lie in it, that of 64
segments of one bit, where a step along an axis flips a bit.  As at most 65 fingerprints
are within one step of a point there, no cell is large however many near copies there are,
and those that share a cell are linked to its smallest.  A fingerprint has 65 such
cells, and only those in crowded cells of the coarse grid are made.
"""

from __future__ import annotations

from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, configure, raw
from .components import connected_components

#: Links need this many differing bits at most; the grid of one step each way is made for it.
BITS = 2
#: Fingerprints, on average, of which one task makes the cells.
FINGERPRINTS = 20_000
_BYTES = np.uint64(0x0101010101010101)
_FULL = 255


def hashes(text: bytes, words: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, repeats included, of the text with A-Z lower-cased."""
    parts = text.lower().split()  # on bytes: A-Z only, and exactly \x20 and \x09-\x0D
    if not parts:
        return np.zeros(0, np.uint64)
    whole = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(whole, seed)], np.uint64)
    ends = list(accumulate(map(len, parts), lambda a, n: a + 1 + n))
    begins = [0, *(e + 1 for e in ends[:-1])]
    cut = [whole[a:b] for a, b in zip(begins, ends[words - 1 :])]
    return np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(seed)), np.uint64, len(cut))


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The 64 majority bits of the shingles' hashes; 0 for a text without words."""
    return majority(hashes(text, words, seed))


def majority(h: np.ndarray) -> int:
    """The bits that are 1 in over half of the hashes."""
    n = len(h)
    if not n:
        return 0
    rows = -(-n // _FULL)
    h = np.concatenate([h, np.zeros(rows * _FULL - n, np.uint64)]).reshape(rows, _FULL)
    out = 0
    for k in range(8):  # eight counters of a byte each in a word, which 255 ones can't overflow
        packed = ((h >> np.uint64(k)) & _BYTES).sum(axis=1, dtype=np.uint64)
        counts = packed.view(np.uint8).reshape(rows, 8).sum(axis=0, dtype=np.int64)
        for j in np.flatnonzero(2 * counts > n):
            out |= 1 << (8 * int(j) + k)
    return out


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long, a row for each row of ``docs``."""
    configure(docs.sparkSession)

    def each(batches):
        for batch in batches:
            got = np.array([fingerprint(x, words, seed) for x in raw(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(each, "doc_id long, fp long")


def _cells(segments: int) -> list[Column]:
    """The grid cell of column fp, then for each segment the cells one step up and one step down,
    null beyond the grid."""
    width = 64 // segments
    field = width.bit_length()  # bits that hold a count of 0 to width
    counts = [F.bit_count(F.shiftrightunsigned("fp", width * s).bitwiseAND(F.lit((1 << width) - 1))).cast("long") for s in range(segments)]
    own = counts[0]
    for s in range(1, segments):
        own = own.bitwiseOR(F.shiftleft(counts[s], field * s))
    near = [own]
    for s, c in enumerate(counts):
        near += [F.when(c < width, own + F.lit(1 << field * s)), F.when(c > 0, own - F.lit(1 << field * s))]
    return near


def links(prints: DataFrame, *, segments: int = 16, crowd: int = 12) -> DataFrame:
    """Edges (u, v) between the distinct fingerprints in column fp, such that the
    components are those of all pairs with 2 or fewer differing bits."""
    if 64 % segments or segments * (64 // segments).bit_length() > 63:
        raise ValueError("segments must divide 64, with all counts fitting in a long: 1, 2, 4, 8 or 16")
    width = 64 // segments
    own, *_ = cells = _cells(segments)
    rows = prints.select("fp", F.explode(F.array_compact(F.array(*cells))).alias("cell"))
    shared = rows.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    # Spark sizes the cells as if each fingerprint had one, and would broadcast what is 33 times as large
    rows = rows.join(shared.hint("merge"), "cell")
    pairs = (
        rows.where(F.col("n") <= crowd)
        .groupBy("cell")
        .agg(F.sort_array(F.collect_list("fp")).alias("all"))
        .select(
            F.explode(
                F.expr(
                    f"flatten(transform(all, (x, i) -> transform(filter(slice(all, i + 2, {crowd}),"
                    f" y -> bit_count(x ^ y) <= {BITS}), y -> struct(x as u, y as v))))"
                )
            ).alias("e")
        )
        .select("e.u", "e.v")
    )
    # the cells of the finest grid in a crowded cell: the fingerprint itself in its own, and in one a step up or
    # down in a segment, those in which a bit of that segment is set or cleared
    first = f"CAST({width} * (bit_count(abs(step) - 1) DIV {width.bit_length()}) AS INT)"
    fine = F.expr(
        f"IF(step = 0, array(fp), transform(filter(sequence({first}, {first} + {width - 1}),"
        " b -> (shiftrightunsigned(fp, b) & 1) = IF(step > 0, 0, 1)), b -> fp ^ shiftleft(1L, b)))"
    )
    stars = (
        rows.where(F.col("n") > crowd)
        .withColumn("step", F.col("cell") - own)
        .select("fp", F.explode(fine).alias("cell"))
        .groupBy("cell")
        .agg(F.collect_set("fp").alias("all"))  # 65 at most
        .where(F.size("all") > 1)
        .select(F.array_min("all").alias("v"), F.explode("all").alias("u"))
        .where("u <> v")
        .select("u", "v")
    )
    return pairs.union(stars).distinct()


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, segments: int = 16, crowd: int = 12
) -> DataFrame:
    """A row (doc_id, fp, component_id) for each row of ``docs``; component_id is the
    smallest id reachable over links of 2 or fewer differing bits, its own included.

    Null and empty texts have fingerprint 0 and are linked like any other.  A row
    without an id gets the component of its fingerprint (null if no row of the
    component has an id).  Repeated rows give repeated rows.  ``words`` and
    ``seed`` fix the shingles' hashes.  ``segments`` sets the grid: 16 leaves one
    pair of unrelated fingerprints in three million to verify.
    """
    work = Workspace(docs.sparkSession, "simhash")
    prints = work.save(fingerprints(docs, id_col=id_col, text_col=text_col, words=words, seed=seed), "prints")
    return grouped(prints, work, segments=segments, crowd=crowd)


def grouped(prints: DataFrame, work: Workspace, *, segments: int = 16, crowd: int = 12) -> DataFrame:
    """The same for rows (doc_id, fp) that are written already."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    # the join needs a list that does not change between its two uses
    distinct = work.save(distinct, "distinct")
    # a fingerprint has 33 cells, so the files, which can be few, are dealt out anew
    dealt = distinct.repartition(max(1, distinct.count() // FINGERPRINTS), "fp")
    roots = connected_components(links(dealt, segments=segments, crowd=crowd), work)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
