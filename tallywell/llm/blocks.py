"""Exchanging keys of text positions between documents, in packed blocks.

Rows of the DataFrames here are blocks: (bucket, kind, data), where data holds
numpy arrays for thousands of positions.  Spark deals blocks out by bucket, so that
a shuffle moves a few large rows, and each bucket is sized to fit in memory.

A document is a distinct (id, text).  ``rid``, 40 bits of a hash of both, fixes the
bucket in which its answers meet its text; there a document is known by its place in
the order of (rid, doc_id, check), ``check`` being 64 bits of another hash, and that
triple names it in results.  So documents whose rids are equal stay apart, and that
hashes may be equal costs time and no result.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import configure, raw, slices, tidy

BLOCK = "bucket int, kind int, data binary"
#: Texts; keys or contexts of a bucket; what is known of a bucket's documents; who
#: these are; keys that very many documents have; single windows.
TEXT, ENTRIES, ANSWER, WHO, HOT, WINDOWS = range(6)
#: What names a document.
WHOSE = ["rid", "doc_id", "check"]
#: Bytes of text that numpy works on at once; it needs some fifty times as much memory.
CHUNK_BYTES = 1 << 19
#: Bytes of text whose entries are gathered before they are dealt out.
FLUSH_BYTES = 16 << 20
#: Bits of a rid, and of a key where false matches do no harm.
SHORT = 40
MASK = np.uint64((1 << SHORT) - 1)
#: A key that more documents have is dealt in finer parts, and so many bytes of such keys are known to all tasks at most.
HOT_DOCUMENTS, HOT_BYTES = 20_000, 16 << 20


def pack(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(arrays, protocol=5))


def unpack(data: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))  # written by pack, in this job


def small(values: np.ndarray) -> np.ndarray:
    """Rising numbers as differences, which compress well."""
    return np.diff(values, prepend=values.dtype.type(0))


def deal(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions in their order) for each bucket that occurs."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        yield int(bucket[part[0]]), part


def runs(values: np.ndarray) -> np.ndarray:
    """Where a new value begins, in an array in which equal values are together."""
    if not len(values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def first_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the position of its smallest, of several the
    first: what is chosen depends on the values in the run only."""
    at = np.arange(len(values), dtype=np.int32)
    have = 1
    while have < width:
        step = min(have, width - have)
        later = values[step:] < values[:-step]
        at = np.where(later, at[step:], at[:-step])
        values = np.where(later, values[step:], values[:-step])
        have += step
    return at


def document_bucket(rid: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(rid.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def tags(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """rid and check."""
    return F.xxhash64(doc_id, text).bitwiseAND(F.lit((1 << SHORT) - 1)), F.xxhash64(F.lit(2), text, doc_id)


def with_tags(docs: DataFrame, id_col: str, text_col: str, prefix: str = "") -> DataFrame:
    """``docs`` with the columns that name a document: of equal rows, they are equal."""
    doc_id, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({prefix + name: c for name, c in zip(WHOSE, (tags(doc_id, text)[0], doc_id, tags(doc_id, text)[1]))})


def prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, doc_id, check, text) of all rows; null texts are empty."""
    configure(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc_id = F.col(id_col).cast("long")
    rid, check = tags(doc_id, text)
    return docs.select(rid.alias("rid"), doc_id.alias("doc_id"), check.alias("check"), text.alias("text"))


def total_bytes(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def buckets_for(size: int, each: int) -> int:
    return max(1, math.ceil(size / each))


def blocks(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, d = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(d, pa.binary())], ["bucket", "kind", "data"])


def by_bucket(table_of: DataFrame, each: Callable[[int, Iterator[tuple[int, int, memoryview]]], list[tuple[int, int, bytes]]]) -> DataFrame:
    """``each`` of a bucket's number and (kind, data) pairs; what a group needed in Python is
    given back after it."""

    def whole(table: pa.Table) -> pa.Table:
        bucket, kinds, data = table["bucket"][0].as_py(), table["kind"].to_pylist(), table["data"]
        out = pa.Table.from_batches([blocks(each(bucket, ((k, x.as_buffer()) for k, x in zip(kinds, data))))])
        tidy()
        return out

    return table_of.groupBy("bucket").applyInArrow(whole, BLOCK)


def text_blocks(rows: DataFrame, buckets: int) -> DataFrame:
    """The rows that have an id, packed for their documents' buckets, equal ones of what a
    task holds once."""

    def each(batches):
        for batch in slices(batches, "text", FLUSH_BYTES):
            rid, ids, check = (batch.column(c).to_numpy(zero_copy_only=False) for c in WHOSE)
            got = raw(batch.column("text"))
            fresh = np.array(list({(r, d, c, t): i for i, (r, d, c, t) in enumerate(zip(rid.tolist(), ids.tolist(), check.tolist(), got))}.values()), np.int64)
            where = document_bucket(rid[fresh], buckets)
            yield blocks([(b, TEXT, pack(rid[fresh[i]], ids[fresh[i]], check[fresh[i]], [got[j] for j in fresh[i]])) for b, i in deal(where)])
        tidy()

    return rows.where("doc_id IS NOT NULL").mapInArrow(each, BLOCK)


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together; a longer one comes alone."""
    begin = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield begin, i
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def anchor_entries(rows: DataFrame, anchors: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], doc_buckets: int, key_buckets: int, flush: int = FLUSH_BYTES) -> DataFrame:
    """Blocks of the anchors of all texts.  ``anchors`` takes texts and returns
    the text's number and the 64-bit key of each anchor.

    Of a key that documents with different ids have in what one task gathers at a time,
    one entry is sent, with their number, and the documents get their answer at once;
    so a key that very many documents have costs one entry per such gathering.
    """

    def flushed(rid: np.ndarray, ids: np.ndarray, check: np.ndarray, doc: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        first = np.unique(np.stack([rid, ids, check]), axis=1, return_index=True)[1]
        if len(first) < len(rid):  # equal rows once
            once = np.zeros(len(rid), bool)
            once[first] = True
            doc, key = doc[once[doc]], key[once[doc]]
        order = np.argsort(key, kind="stable")  # and so by document
        key, doc = key[order], doc[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        key, doc = key[fresh], doc[fresh]
        begins = runs(key)
        lengths = np.diff(begins, append=len(key))
        of = ids[doc]
        local = np.repeat(np.minimum.reduceat(of, begins) != np.maximum.reduceat(of, begins), lengths) if len(key) else np.zeros(0, bool)
        out = []
        where = document_bucket(rid, doc_buckets)
        for b, i in deal(where[doc[local]]):
            out.append((b, ANSWER, answer(rid[doc[local][i]], key[local][i])))
        sent = ~local
        sent[begins] = True
        times = np.where(local, np.repeat(lengths, lengths), 1)[sent].astype(np.uint32)
        key, doc = key[sent], doc[sent]
        to = ((key >> np.uint64(SHORT)) % np.uint64(key_buckets)).astype(np.int32)
        for b, i in deal(to):
            i = i[np.argsort(doc[i], kind="stable")]
            used, at = np.unique(doc[i], return_inverse=True)
            out.append((b, ENTRIES, pack(shorten(rid[used].view(np.uint64)), ids[used], small(at.astype(np.uint32)), shorten(key[i]), times[i])))
        return blocks(out)

    def each(batches):
        parts, base, held = [], 0, 0
        for batch in slices(batches, "text", CHUNK_BYTES):
            got = raw(batch.column("text"))
            doc, key = anchors(got)
            parts.append((*(batch.column(c).to_numpy(zero_copy_only=False) for c in WHOSE), doc.astype(np.int32) + np.int32(base), key))
            base, held = base + len(got), held + sum(map(len, got))
            if held >= flush:
                yield flushed(*map(np.concatenate, zip(*parts)))
                parts, base, held = [], 0, 0
        if parts:
            yield flushed(*map(np.concatenate, zip(*parts)))
        tidy()

    return rows.where("doc_id IS NOT NULL").mapInArrow(each, BLOCK)


def shorten(key: np.ndarray) -> np.ndarray:
    """The low SHORT bits of each key as bytes."""
    return np.ascontiguousarray(key).view(np.uint8).reshape(-1, 8)[:, : SHORT // 8].copy()


def lengthen(short: np.ndarray) -> np.ndarray:
    out = np.zeros((len(short), 8), np.uint8)
    out[:, : SHORT // 8] = short
    return out.view(np.uint64).ravel()


def answer(rid: np.ndarray, key: np.ndarray) -> bytes:
    """The documents and the keys that they share with others.  Which document has which is
    not said: a key that one document shares, all that have it do."""
    return pack(shorten(np.unique(rid).view(np.uint64)), shorten(np.unique(key & np.uint64((1 << SHORT) - 1))))


def shared_anchors(entries: DataFrame, doc_buckets: int, hot: int | None = None) -> DataFrame:
    """Answers for documents' buckets: the keys of their anchors that a document with
    another id has too (or, once in billions, one with equal short keys).  With
    ``hot`` also the short keys that more documents have, by the logarithm of their number."""

    def each(bucket, pairs):
        out, parts, base = [], [], 0
        for kind, data in pairs:
            if kind == ANSWER:
                out.append((bucket, ANSWER, bytes(data)))
                continue
            rid, ids, at, short, times = unpack(data)
            parts.append((lengthen(rid), ids, (np.cumsum(at, dtype=np.int64) + base).astype(np.int32), lengthen(short), times))
            base += len(ids)
        if not parts:
            return out
        rid, ids, doc, key, times = map(np.concatenate, zip(*parts))
        del parts
        order = np.argsort(key, kind="stable")
        key, doc, times = key[order], doc[order], times[order]
        begins = runs(key)
        lengths = np.diff(begins, append=len(key))
        of = ids[doc]
        kept = (np.minimum.reduceat(of, begins) != np.maximum.reduceat(of, begins)) | (np.maximum.reduceat(times, begins) > 1)
        if hot is not None:
            n = np.add.reduceat(times.astype(np.int64), begins)
            often = np.flatnonzero(n > hot)
            for size, i in deal(np.log2(n[often]).astype(np.int32)):
                out.append((size, HOT, pack(shorten(key[begins[often[i]]]))))
        kept = np.repeat(kept, lengths)
        key, doc = key[kept], doc[kept]
        for b, i in deal(document_bucket(rid, doc_buckets)[doc]):
            out.append((b, ANSWER, answer(rid[doc[i]], key[i])))
        return out

    return by_bucket(entries, each)


def hot_keys(answers: DataFrame) -> np.ndarray:
    """The short keys in HOT blocks; where they are more than HOT_BYTES, those that
    the most documents have."""
    found = answers.where(F.col("kind") == HOT)
    sizes = {r.bucket: r.n for r in found.groupBy("bucket").agg(F.sum(F.octet_length("data")).alias("n")).collect()}  # one for each power of two
    least, held = 64, 0
    for size in sorted(sizes, reverse=True):
        held += sizes[size]
        if held > HOT_BYTES:
            break
        least = size
    got = [lengthen(unpack(r.data)[0]) for r in found.where(F.col("bucket") >= least).select("data").toLocalIterator()]
    return np.unique(np.concatenate(got)) if got else np.zeros(0, np.uint64)


@dataclass
class Documents:
    """A bucket's distinct documents in their order; texts of those that no answer is about
    are None.  ``answers`` has the answers' data."""

    rid: np.ndarray
    ids: np.ndarray
    check: np.ndarray
    texts: list[bytes | None]
    answers: list

    def who(self, bucket: int) -> tuple[int, int, bytes]:
        return bucket, WHO, pack(self.rid, self.ids, self.check)

    def wanted(self) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        """Places and texts, about CHUNK_BYTES at a time."""
        places = np.array([i for i, t in enumerate(self.texts) if t is not None], np.int64)
        held = [self.texts[i] for i in places]
        for b, e in chunks(held):
            yield places[b:e], held[b:e]


def opened(pairs: Iterator[tuple[int, memoryview]], by_rid: bool) -> Documents:
    """The documents of a bucket.  ``by_rid`` tells if answers name documents by rid or by place."""
    answers, parts, seen = [], [], {}
    for kind, data in pairs:
        if kind == ANSWER:
            answers.append(unpack(data))
        elif kind == TEXT:
            parts.append(data)
    none = np.zeros(0, np.int64)
    if not answers:
        return Documents(none, none, none, [], [])
    named = np.unique(np.concatenate([lengthen(a[0]) if by_rid else a[0] for a in answers]))
    # equal rows once; what decides the order of documents with equal tags is their text
    rows = sorted({row for data in parts for row in zip(*(x.tolist() if isinstance(x, np.ndarray) else x for x in unpack(data)))})
    if not rows:
        return Documents(none, none, none, [], [])
    rid, ids, check = (np.array(c, np.int64) for c in list(zip(*rows))[:3])
    wanted = np.isin(rid.view(np.uint64) if by_rid else np.arange(len(rid)), named).tolist()
    return Documents(rid, ids, check, [r[3] if w else None for r, w in zip(rows, wanted)], answers)


def ranges_block(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> bytes:
    """Half-open ranges of window starts of the documents at these places."""
    i = np.lexsort((begin, doc))
    used, at = np.unique(doc[i], return_inverse=True)
    return pack(used.astype(np.uint32), small(at.astype(np.uint32)), begin[i].astype(np.uint32), (end[i] - begin[i]).astype(np.uint32))


def range_answers(home: np.ndarray, doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int, bytes]]:
    return [(b, ANSWER, ranges_block(doc[i], begin[i], end[i])) for b, i in deal(home)]


def spans(found: DataFrame, width: int) -> DataFrame:
    """(rid, doc_id, check, begins, ends): the merged spans that windows of ``width`` starting in
    the answers' ranges cover, a row for each document that has any."""
    schema = "rid long, doc_id long, check long, begins array<int>, ends array<int>"

    def each(table: pa.Table) -> pa.Table:
        docs, begins, ends, who = [], [], [], None
        for kind, data in zip(table["kind"].to_pylist(), table["data"]):
            if kind == WHO:
                who = unpack(data.as_buffer())
            elif kind == ANSWER:
                doc, at, begin, length = unpack(data.as_buffer())
                docs.append(doc[np.cumsum(at, dtype=np.int64)].astype(np.int64))
                begins.append(begin.astype(np.int64))
                ends.append(begin.astype(np.int64) + length + (width - 1))
        out = [[] for _ in range(5)]
        if docs:
            doc, begin, end = map(np.concatenate, (docs, begins, ends))
            order = np.lexsort((begin, doc))
            doc, begin, end = doc[order], begin[order], end[order]
            for i in np.split(np.arange(len(doc)), runs(doc)[1:]):
                top = np.maximum.accumulate(end[i])
                new = np.concatenate([[True], begin[i][1:] > top[:-1]])
                last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(i) - 1]])
                for column, value in zip(out, (*(int(w[doc[i[0]]]) for w in who), begin[i][new].tolist(), top[last].tolist())):
                    column.append(value)
        types = [pa.int64()] * 3 + [pa.list_(pa.int32())] * 2
        out = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, types)], [*WHOSE, "begins", "ends"])
        tidy()
        return out

    return found.where(F.col("kind").isin(WHO, ANSWER)).groupBy("bucket").applyInArrow(each, schema)


def with_spans(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the arrays _begins and _ends of ``spans``, null for those without any."""
    names = {c: f"_{c}" for c in (*WHOSE, "begins", "ends")}
    on = [f"_{c}" for c in WHOSE]
    return with_tags(docs, id_col, text_col, "_").join(found.withColumnsRenamed(names), on, "left").drop(*on)
