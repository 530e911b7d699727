"""Near copies: texts whose sets of word shingles overlap by 0.8 or more (Jaccard).

Equal sets, by 128 bits, count as one.  Texts whose SimHash fingerprints, of the same shingles,
link at 2 or fewer bits (simhash.grouped: segment popcounts, a range-join on the grid) are
compared with the first of their component.  Near copies can differ in more bits, which no grid
reaches; these have shingles in common, by which they are found without loss.

For that, each shingle that no other text has is found out,
by an exchange of all shingles' keys (blocks.shared_anchors).  A set of n shingles of which fewer
than 0.8 n are shared has no near copy and is left out, so texts that have only passages in
common with others cost nothing more.  Two similar sets share 0.8 n or more, so under any one
order of all shingles they share one of the first S - ceil(0.8 n) + 1 of the S shared ones of
each: texts are grouped by these.  The order decides the work and not the result; shingles that very
many texts have come last.

Of the texts that meet at a shingle, each is compared with the first; once these are linked, twice with
those before it that are in another group; and at last all that are still in different groups
are.  Nothing is left out by this, as links within a group change nothing.  Pairs go on if their sizes
and the place of the shingle in both leave enough others to share, and if the parities of their
shingles in 512 buckets, a fingerprint, differ in no more places than shingles may.  What is
left is verified by the 64-bit hashes of all shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import Workspace, configure, raw, slices, tidy
from .components import connected_components
from .simhash import grouped, hashes, majority

#: Words of a shingle; and pairs count from a Jaccard similarity of 4 / 5.
WORDS = 5
#: Of the texts in other groups that meet at a shingle, so many less one are compared before all are.
CROWD = 12
#: Shingles that more texts have come last.
COMMON = 100
#: Pairs that are broadcast, at most: two longs each.
MOST_PAIRS = 1_000_000
#: Of texts whose shingles a task holds at once.
BYTES = 1 << 20
_BUCKETS = 512
_BITS = [f"bits{k}" for k in range(_BUCKETS // 64)]


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    return np.unique(hashes(text, words))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity is 4 / 5 or more."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * shared >= 4 * (len(a) + len(b))


def prefix(s: np.ndarray, shared: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Of a set the first of its shared shingles, common ones last: similar sets share one of them.
    None if too few are shared for any set to be similar."""
    left = len(shared) - (4 * len(s) + 4) // 5 + 1
    if left <= 0 or not len(s):
        return shared[:0]
    last = _among(shared & blocks.MASK, common)
    return np.concatenate([shared[~last], shared[last]])[:left]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def parities(s: np.ndarray) -> list[int]:
    """The parity of the number of shingles in each bucket."""
    odd = np.bincount((s % np.uint64(_BUCKETS)).astype(np.int64), minlength=_BUCKETS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Rows sorted by key as columns, each time with all rows of the keys in them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
        if held and held[-1].column("key")[-1].as_py() != key[0] or cut:
            t = pa.Table.from_batches([*held, batch.slice(0, cut)])
            if t.num_rows:
                yield {c: t[c].to_numpy() for c in t.column_names}
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        t = pa.Table.from_batches(held)
        yield {c: t[c].to_numpy() for c in t.column_names}


def _possible(t: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows may be similar, by size and by the place of the shingle, and then by
    their parities."""
    n, pos = t["n"], t["pos"]
    most = n[i] + n[j]
    out = 9 * np.minimum(n[i] - pos[i], n[j] - pos[j]) >= 4 * most
    at = np.flatnonzero(out)
    differ = np.zeros(len(at), np.int64)
    for c in _BITS:
        differ += np.bitwise_count((t[c][i[at]] ^ t[c][j[at]]).view(np.uint64))  # of signed numbers it counts the absolute value's
    out[at] = 9 * differ <= most[at]
    return out


def _edges(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and node, each with the first that has its key."""
    return _pairs(batches, 0)


def _pairs(batches: Iterator[pa.RecordBatch], back: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those with one key: each with the ``back`` before it that are in
    another group, or with the first if that is 0.  No more than these are held between batches."""
    before: dict[str, np.ndarray] = {}  # of the last key the first row, or the last ones
    for batch in batches:
        if not batch.num_rows:
            continue
        t = {c: batch.column(c).to_numpy() for c in batch.schema.names}
        held = 0
        if before and before["key"][0] == t["key"][0]:
            held = len(before["key"])
            t = {c: np.concatenate([before[c], t[c]]) for c in t}
        key, node = t["key"], t["node"]
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        fresh = np.arange(held, len(key))
        i, j = [fresh[:0]], [fresh[:0]]
        if not back:
            i, j = [fresh], [np.repeat(begins, np.diff(begins, append=len(key)))[held:]]
        for d in range(1, min(back, len(key) - 1) + 1):
            at = fresh[fresh >= d]
            at = at[key[at] == key[at - d]]
            if not len(at):
                break
            at = at[t["root"][at] != t["root"][at - d]]
            i.append(at)
            j.append(at - d)
        i, j = np.concatenate(i), np.concatenate(j)
        other = node[i] != node[j]
        i, j = i[other], j[other]
        some = _possible(t, i, j)
        if some.any():
            yield _edges(node[i[some]], node[j[some]])
        last = int(begins[-1])
        keep = np.arange(max(last, len(key) - back), len(key)) if back else np.array([last])
        before = {c: x[keep] for c, x in t.items()}


def _unlinked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those with one key that are not in one group: each that is not in
    the largest group there is compared with all others of about its size, by the place of the
    shingle and by their parities; what may be similar goes on."""
    for t in _runs(batches):
        ends = [*(np.flatnonzero(np.diff(t["key"])) + 1).tolist(), len(t["key"])]
        for a, b in zip([0, *ends], ends):
            _, group, size = np.unique(t["root"][a:b], return_inverse=True, return_counts=True)
            if len(size) < 2:
                continue
            order = np.argsort(t["n"][a:b], kind="stable")
            g = {c: x[a:b][order] for c, x in t.items()}
            n, group = g["n"], group[order]
            for i in np.flatnonzero(group != size.argmax()).tolist():
                j = np.arange(np.searchsorted(n, -(-4 * n[i] // 5)), np.searchsorted(n, 5 * n[i] // 4, "right"))
                j = j[group[j] != group[i]]
                j = j[_possible(g, np.full(len(j), i), j)]
                if len(j):
                    yield _edges(np.full(len(j), g["node"][i]), g["node"][j])


def _verified(pairs: DataFrame, rows: DataFrame, text_col: str, words: int) -> DataFrame:
    """Of pairs, distinct and written, those of similar texts.  Pairs of a bounded number are broadcast to
    the texts, so that only sets of shingles are shuffled; more are joined by shuffling."""
    sent = F.broadcast if pairs.count() <= MOST_PAIRS else (lambda x: x)

    def sets(names: list[str]):
        def each(batches):
            for batch in batches:
                for part in slices(iter([batch]), text_col, BYTES):
                    got = [shingle_set(x, words).tobytes() for x in raw(part.column(text_col))]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(got, pa.binary())], [*names, "s"])
            tidy()

        return each

    def check(batches):
        for batch in batches:
            both = zip(batch.column("s_u"), batch.column("s_v"))
            keep = [similar(*(np.frombuffer(x.as_buffer(), np.uint64) for x in p)) for p in both]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
        tidy()

    texts = rows.select("_row", text_col)
    one = texts.join(sent(pairs), F.col("_row") == F.col("u")).select("u", "v", text_col).mapInArrow(sets(["u", "v"]), "u long, v long, s binary")
    heads = pairs.select("v").distinct()
    other = texts.join(sent(heads), F.col("_row") == F.col("v")).select("v", text_col).mapInArrow(sets(["v"]), "v long, s binary")
    both = one.withColumnRenamed("s", "s_u").join(other.withColumnRenamed("s", "s_v"), "v")
    return both.select("u", "v", "s_u", "s_v").mapInArrow(check, "u long, v long")


def _keys(unique: DataFrame, words: int, work: Workspace) -> DataFrame:
    """(key, node, n, pos): the prefixes of the sets of ``unique``'s texts, pos being such that
    n - pos shared shingles are left from the key on."""

    def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [shingle_set(x, words) for x in texts]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.repeat(np.arange(len(got)), sizes), np.concatenate(got) if got else np.zeros(0, np.uint64)

    size = blocks.total_bytes(unique)
    doc_buckets, key_buckets = blocks.buckets_for(size, 6 << 20), blocks.buckets_for(size, 3 << 20)
    entries = blocks.anchor_entries(unique, shingles, doc_buckets, key_buckets, 6 << 20)
    answers = work.save(blocks.shared_anchors(entries, doc_buckets, COMMON), "answers")
    work.drop()
    common = blocks.hot_keys(answers)

    def each(table: pa.Table) -> pa.Table:
        docs = blocks.opened(((k, x.as_buffer()) for k, x in zip(table["kind"].to_pylist(), table["data"])), by_rid=True)
        out = [[np.zeros(0, t)] for t in (np.uint64, np.int64, np.int64, np.int64)]
        if docs.answers:
            known = np.unique(np.concatenate([blocks.lengthen(a[1]) for a in docs.answers]))
            for places, texts in docs.wanted():
                for place, text in zip(places.tolist(), texts):
                    s = shingle_set(text, words)
                    shared = s[_among(s & blocks.MASK, known)]
                    first = prefix(s, shared, common)
                    values = first, np.full(len(first), docs.ids[place]), np.full(len(first), len(s)), len(s) - len(shared) + np.arange(len(first))
                    for column, value in zip(out, values):
                        column.append(value)
        key, *rest = map(np.concatenate, out)
        tidy()
        return pa.table([pa.array(key.view(np.int64)), *map(pa.array, rest)], names=["key", "node", "n", "pos"])

    both = blocks.text_blocks(unique, doc_buckets).union(answers.where(F.col("kind") != blocks.HOT))
    keys = both.groupBy("bucket").applyInArrow(each, "key long, node long, n long, pos long")
    keys = work.save(keys, "all_keys")
    work.drop("answers")
    met = keys.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    return work.save(keys.join(met.hint("merge"), "key", "left_semi"), "keys")  # both are far larger than their files


def near_copies(docs: DataFrame, *, text_col: str = "text", words: int = WORDS, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """``docs`` with a number _row for each row, and (_row, _group) for each row: _group is
    the smallest _row reachable over pairs of similar texts.

    Texts without words are copies of each other.  Texts of fewer than ``words`` words have
    one shingle, the whole text.
    """
    spark = docs.sparkSession
    configure(spark)
    work = Workspace(spark, "copies")
    rows = work.save(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")

    def each(batches):
        for batch in slices(batches, text_col, BYTES):
            all_hashes = [hashes(x, words) for x in raw(batch.column(1))]
            prints = np.array([majority(h) for h in all_hashes], np.uint64).view(np.int64)
            got = [np.unique(h) for h in all_hashes]
            digests = np.array([(d >> 64, d % 2**64) for d in (xxhash.xxh3_128_intdigest(s.tobytes()) for s in got)], np.uint64).reshape(-1, 2).view(np.int64)
            columns = [batch.column(0), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([len(s) for s in got], pa.int64()), pa.array([parities(s) for s in got], pa.list_(pa.int64())), pa.array(prints)]
            yield pa.RecordBatch.from_arrays(columns, ["_row", "d1", "d2", "n", "bits", "fp"])
        tidy()

    made = rows.select("_row", text_col).mapInArrow(each, "_row long, d1 long, d2 long, n long, bits array<long>, fp long")
    sets = work.save(made, "sets")
    firsts = sets.groupBy("d1", "d2").agg(F.min("_row").alias("node"))
    members = work.save(sets.select("_row", "d1", "d2").join(firsts, ["d1", "d2"]).select("_row", "node"), "members")
    again = members.where("_row <> node").select("_row")
    unique = rows.join(F.broadcast(again) if again.count() <= MOST_PAIRS else again, "_row", "left_anti")
    rid, text = F.xxhash64("_row").bitwiseAND(F.lit((1 << blocks.SHORT) - 1)), F.coalesce(text_col, F.lit(""))
    unique = unique.select(rid.alias("rid"), F.col("_row").alias("doc_id"), F.lit(0).cast("long").alias("check"), text.alias("text"))
    own = members.where("_row = node").select("_row").hint("merge")  # numbers in sequence take a byte or two in files
    prints = work.save(sets.join(own, "_row").select(F.col("_row").alias("doc_id"), "fp"), "prints")
    near = grouped(prints, Workspace(spark, "copies")).where("doc_id <> component_id").select(F.col("doc_id").alias("u"), F.col("component_id").alias("v"))
    keys = _keys(unique, words, work)

    own = sets.select(F.col("_row").alias("node"), *(F.col("bits")[k].alias(c) for k, c in enumerate(_BITS)))
    met = work.save(keys.join(own, "node").select("key", "node", "n", "pos", *_BITS), "met")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = work.save(pairs.distinct(), f"{name}_pairs")
        out = work.save(_verified(pairs, rows, text_col, words), name)
        work.drop(f"{name}_pairs")
        return out

    def apart(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The keys with the texts' groups, where texts in several groups meet; and as fewer links, each text's to
        the first of its group."""
        stars = connected_components(links, Workspace(spark, "copies")).select(F.col("node").alias("u"), F.col("root").alias("v"))
        roots = stars.select(F.col("u").alias("_node"), F.col("v").alias("root"))
        out = keys.join(roots, F.col("node") == F.col("_node"), "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        split = out.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
        return met.join(out.join(split, "key", "left_semi"), ["key", "node"]).repartition("key"), stars

    def chosen(pairs: DataFrame) -> DataFrame:
        """One for each text, as most of what is likely is similar and links do the rest."""
        return pairs.groupBy("u").agg(F.min("v").alias("v"))

    first = met.repartition("key").sortWithinPartitions("key", "node")
    links = verified(near.union(chosen(first.mapInArrow(_firsts, "u long, v long"))), "links")
    for turn in range(2):
        left, links = apart(links)
        left = left.sortWithinPartitions("key", "n", "node")
        links = links.union(verified(chosen(left.mapInArrow(lambda x: _pairs(x, max(1, crowd - 1)), "u long, v long")), f"more{turn}"))
    left, links = apart(links)
    left = left.sortWithinPartitions("key")
    links = links.union(verified(left.mapInArrow(_unlinked, "u long, v long"), "rest"))
    work.drop("sets", "prints", "keys", "all_keys", "met")
    roots = connected_components(links, Workspace(spark, "copies"))
    groups = members.join(roots, "node", "left").select("_row", F.coalesce("root", "node").alias("_group"))
    return rows, groups
