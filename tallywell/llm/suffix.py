"""Substring duplicates by a distributed suffix array.

A byte goes if a string of ``width`` bytes that covers it also starts in a
document with a smaller id.  Sorting the suffixes at all positions would move the
text some fifty times, so only suffixes at anchors are sorted: of the substrings
of ``gram`` bytes inside each window of ``width`` bytes the one with the least
hash, which equal windows have at equal offsets.  The steps:

1. Anchors whose gram no other document has are dropped (blocks.shared_anchors).  This
   loses nothing: a false match of hashes there costs work only.
2. Each remaining anchor's suffix, as far as a window reaches, goes with the bytes
   before it to a range of suffixes.  The ranges lie between splitters, leading tokens of 16
   bytes from a bounded sample; a token that fills whole ranges is split by longer ones.
   Of equal suffixes with equal bytes before them, one task sends those of its smallest
   document only, and marks the others at once, so a passage in very many documents
   stays small.
3. A range sorts its suffixes by multikey quicksort, 8 bytes a step, and takes the longest
   common prefixes of neighbours, likewise for the bytes before them: these tell which
   windows are equal (matching.smaller), and all but the smallest document's are marked.
4. Across the ends of ranges: windows whose suffix shares enough bytes with a splitter to
   have an equal beyond it are dealt out once more, by themselves, and compared.

Bytes are compared throughout, so results are exact, whatever the sample and the hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .blocks import ANSWER, ENTRIES, WINDOWS, deal, first_least, mixed, pack, runs, unpack
from .common import Workspace, raw, slices
from .matching import big_endian, multikey_sort, smaller, spread, stretches

#: Bytes of a window, of the gram that anchors it, and of the leading token.
WIDTH, GRAM, LEAD = 50, 20, 16
BEFORE, CONTEXT = WIDTH - GRAM, 2 * WIDTH - GRAM
#: About so many documents give the splitters.
SAMPLE_ROWS = 2000

_TABLE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(CONTEXT, _STEP, np.uint64))])
_SHORT_MASK = np.uint64((1 << blocks.SHORT) - 1)


def _grams(buf: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position, from hashes of doubling length."""
    have, h = 1, _TABLE[buf]
    whole = {1: h}
    while have * 2 <= GRAM:
        h = h[:-have] * _POWERS[have] + h[have:]
        have *= 2
        whole[have] = h
    for size in sorted(whole, reverse=True):
        if have + size <= GRAM:
            tail = whole[size][have:]
            h = h[: len(tail)] * _POWERS[size] + tail
            have += size
    return mixed(h)


def anchors(texts: list[bytes], bits: int = 64) -> tuple[np.ndarray, ...]:
    """(text's number, key, position, first and last start of the windows that have
    this anchor), positions being in the joined texts; then the joined bytes and
    where each text begins in them."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    buf = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(buf) < WIDTH:
        return none, none.astype(np.uint64), none, none, none, buf, starts
    h = _grams(buf) & np.uint64((1 << bits) - 1)
    at = first_least((h >> np.uint64(32)).astype(np.uint32), BEFORE + 1)
    ok = np.zeros(len(at) + 1, np.int8)  # +1 where a text's windows begin, -1 after them
    fits = lengths >= WIDTH
    np.add.at(ok, starts[:-1][fits], 1)
    np.add.at(ok, starts[1:][fits] - WIDTH + 1, -1)
    p = np.flatnonzero(np.cumsum(ok, dtype=np.int8)[:-1] > 0)
    a = at[p].astype(np.int64)
    begins = runs(a)
    ends = np.concatenate([begins[1:], [len(p)]]) - 1 if len(p) else begins
    a = a[begins]
    doc = np.searchsorted(starts[1:], a, "right")  # by their ends, which tells empty texts apart
    return doc, h[a], a, p[begins], p[ends], buf, starts


def _words(context: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Sort keys: the suffix, the bytes before it from the last to the first, and how
    much of either the document has."""
    return np.hstack([np.ascontiguousarray(context).view(">u8").astype(np.uint64), edge[:, None].astype(np.uint64)])


def _suffixes(buf: np.ndarray, a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes from each anchor on and those before it, reversed; zero outside of
    its document, which spans low to high."""
    out = np.zeros((len(a), CONTEXT), np.uint8)
    after, before = np.minimum(high - a, WIDTH), np.minimum(a - low, BEFORE)
    top = len(buf) - 1
    for j in range(WIDTH):
        out[:, j] = np.where(j < after, buf[np.minimum(a + j, top)], 0)
    for j in range(BEFORE):
        out[:, WIDTH + j] = np.where(j < before, buf[np.maximum(a - 1 - j, 0)], 0)
    return out, (before * 64 + after).astype(np.uint16)


def _cut(cuts: np.ndarray, bits: int):
    """For a bucket of documents: entries for the suffix ranges, and what is decided here."""

    def each(bucket, pairs):
        docs = blocks.opened(pairs, by_rid=True)
        if not docs.answers:
            return []
        known = np.unique(np.concatenate([blocks.lengthen(a[1]) for a in docs.answers]))
        parts = []
        for places, texts in docs.wanted():
            doc, key, a, p1, p2, buf, starts = anchors(texts, bits)
            key &= _SHORT_MASK
            k = np.flatnonzero(known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key)
            doc, a, p1, p2 = doc[k], a[k], p1[k], p2[k]
            context, edge = _suffixes(buf, a, starts[doc], starts[doc + 1])
            parts.append((context, edge, places[doc], (a - starts[doc]).astype(np.uint32), (a - p2).astype(np.uint8), (a - p1).astype(np.uint8)))
        if not sum(len(x[0]) for x in parts):
            return []
        context, edge, doc, pos, near, far = (np.concatenate(x) for x in zip(*parts))
        del parts
        ids = docs.ids[doc]
        order, new = multikey_sort(_words(context, edge))
        begins = np.flatnonzero(new)
        least = np.empty(len(doc), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(ids[order], begins), np.diff(begins, append=len(doc)))
        out = [docs.who(bucket)]
        later = np.flatnonzero(ids > least)
        if len(later):
            at = pos[later].astype(np.int64)
            out.append((bucket, ANSWER, blocks.ranges_block(doc[later], at - far[later], at - near[later] + 1)))
        keep = order[ids[order] == least[order]]
        lead = np.ascontiguousarray(context[keep, :WIDTH]).view(f"S{WIDTH}").ravel()
        for to, i in deal(np.searchsorted(cuts, lead, "right").astype(np.int32)):
            i = keep[i]
            used, at = np.unique(doc[i], return_inverse=True)
            out.append((to, ENTRIES, pack(bucket, used.astype(np.uint32), docs.ids[used], at.astype(np.uint32), context[i], edge[i], pos[i], near[i], far[i])))
        return out

    return each


def _opened(pairs, kind: int, out: list) -> list[np.ndarray]:
    """The columns home, document and id, and what else blocks of this kind hold; the other blocks
    go to ``out``."""
    parts = []
    for bucket, got, data in pairs:
        if got != kind:
            out.append((bucket, got, bytes(data)))
            continue
        home, used, ids, at, *rest = unpack(data)
        parts.append((np.full(len(at), home, np.int32), used[at], ids[at], *rest))
    return [np.concatenate(x) for x in zip(*parts)]


def _touching(forward: np.ndarray, cuts: np.ndarray, bucket: int) -> np.ndarray:
    """How many bytes each suffix has in common with the nearer end of its range: it can share
    no more with any suffix beyond."""
    most = np.zeros(len(forward), np.int64)
    for end in (bucket - 1, bucket):
        if 0 <= end < len(cuts):
            edge = np.frombuffer(bytes(cuts[end]).ljust(WIDTH, b"\0"), np.uint8)
            differ = forward != edge
            most = np.maximum(most, np.where(differ.any(axis=1), differ.argmax(axis=1), WIDTH))
    return most


def _compare(cuts: np.ndarray, ranges: int):
    """For a range of suffixes: the ranges of window starts that smaller documents have, and
    the windows that may have an equal one beyond the ends of the range."""

    def each(bucket, pairs):
        out: list[tuple[int, int, bytes]] = []
        columns = _opened(((bucket, k, d) for k, d in pairs), ENTRIES, out)
        if not columns:
            return out
        home, doc, ids, context, edge, pos, near, far = columns
        del columns
        order, new = multikey_sort(_words(context, edge))
        home, doc, ids, context, pos, near, far = (x[order] for x in (home, doc, ids, context, pos, near, far))
        pos = pos.astype(np.int64)
        begins = np.flatnonzero(new)
        lengths = np.diff(begins, append=len(ids))
        least = np.minimum.reduceat(ids, begins)
        of = np.repeat(np.arange(len(begins)), lengths)
        context = context[begins]
        forward, backward = context[:, :WIDTH], context[:, WIDTH:]
        low, high = near[begins].astype(np.int64), far[begins].astype(np.int64)
        marks, _ = smaller(forward, backward, WIDTH, low, high, least, least, GRAM)
        later = np.flatnonzero(ids > least[of])
        got = [(home[later], doc[later], pos[later] - far[later], pos[later] - near[later] + 1)]
        firsts = np.flatnonzero(ids == least[of])  # the places of each context in its least document
        first_of = np.searchsorted(of[firsts], np.arange(len(begins) + 1))
        c, o1, o2 = stretches(marks)
        n = np.diff(first_of)[c]
        row = firsts[spread(first_of[c], n)]
        got.append((home[row], doc[row], pos[row] - np.repeat(o2, n) + 1, pos[row] - np.repeat(o1, n) + 1))
        out += blocks.range_answers(*(np.concatenate(x) for x in zip(*got)))
        touch = _touching(forward, cuts, bucket)
        held, size = [], 0
        for o in range(BEFORE + 1):
            c = np.flatnonzero((touch >= max(GRAM, WIDTH - o)) & (low <= o) & (o <= high) & ~marks[:, o])
            n = np.diff(first_of)[c]
            row = firsts[spread(first_of[c], n)]
            window = np.concatenate([backward[c, :o][:, ::-1], forward[c, : WIDTH - o]], axis=1)
            held.append((home[row], doc[row], ids[row], pos[row] - o, np.repeat(window, n, axis=0)))
            size += len(row)
            if size > 50_000 or o == BEFORE:
                out += _dealt(*(np.concatenate(x) for x in zip(*held)), ranges)
                held, size = [], 0
        return out

    return each


def _dealt(home, doc, ids, start, window, ranges: int) -> list[tuple[int, int, bytes]]:
    """Windows to the buckets of their hashes."""
    h = np.zeros(len(window), np.uint64)
    for j in range(WIDTH):
        h = h * _STEP + _TABLE[window[:, j]]
    out = []
    for to, i in deal((mixed(h) % np.uint64(ranges)).astype(np.int32)):
        for b, j in deal(home[i]):
            used, at = np.unique(doc[i[j]], return_inverse=True)
            own = np.zeros(len(used), np.int64)
            own[at] = ids[i[j]]
            out.append((to, WINDOWS, pack(b, used, own, at.astype(np.uint32), start[i[j]].astype(np.uint32), window[i[j]])))
    return out


def _across(bucket, pairs):
    """For windows from both sides of the ranges' ends: those that a smaller document has."""
    out: list[tuple[int, int, bytes]] = []
    columns = _opened(((bucket, k, d) for k, d in pairs), WINDOWS, out)
    if not columns:
        return out
    home, doc, ids, start, window = columns
    order, new = multikey_sort(big_endian(window))
    begins = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(ids[order], begins), np.diff(begins, append=len(ids)))
    i = order[ids[order] > least]
    start = start[i].astype(np.int64)
    return out + blocks.range_answers(home[i], doc[i], start, start + 1)


def _splitters(rows: DataFrame, ranges: int, sample_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading tokens that cut the suffixes of a sample into ``ranges`` equal parts, and, for
    tokens that fill more than one part, the longer suffixes that cut them."""

    def each(batches):
        for batch in slices(batches, "text", blocks.CHUNK_BYTES):
            _, _, a, _, _, buf, _ = anchors(raw(batch.column("text")))
            a = a[:: max(1, len(a) // 500)]
            got = [bytes(buf[x : x + WIDTH]) for x in a]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary())], ["lead"])

    none = np.zeros(0, f"S{LEAD}")
    if ranges < 2:
        return none, none
    n = rows.count()
    share = int(1_000_000 * min(1.0, sample_rows / max(n, 1))) + 1
    sample = rows.where(F.pmod("rid", F.lit(1_000_000)) < share)
    got = np.sort(np.array([r.lead for r in sample.mapInArrow(each, "lead binary").collect()], f"S{WIDTH}"))
    if not len(got):
        return none, none
    at = got[[len(got) * i // ranges for i in range(1, ranges)]]
    token, times = np.unique(at.astype(f"S{LEAD}"), return_counts=True)
    return token, np.unique(at[np.isin(at.astype(f"S{LEAD}"), token[times > 1])])


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, bits: int = 64) -> DataFrame:
    """(rid, doc_id, check, begins, ends): for each document with any, the merged half-open
    spans of UTF-8 bytes covered by strings of WIDTH bytes that also start in a document with
    a smaller id.  The first three are ``blocks.prepared``'s.

    A null text is empty.  Rows without an id neither lose bytes nor cost others any.
    Rows with equal ids are one document as far as ids go: none loses bytes to
    another.  Texts under WIDTH bytes lose nothing.  No rows give no rows.
    ``bits`` are used of anchors' hashes; fewer make more work and the same result.
    """
    work = Workspace(docs.sparkSession, "suffix")
    rows = blocks.prepared(docs, id_col, text_col)
    size = blocks.total_bytes(rows)
    doc_buckets, key_buckets, ranges = (blocks.buckets_for(size, n << 20) for n in (6, 12, 5))
    cuts = np.unique(np.concatenate(_splitters(rows, ranges, sample_rows)))
    entries = blocks.anchor_entries(rows, lambda t: anchors(t, bits)[:2], doc_buckets, key_buckets)
    answers = work.save(blocks.shared_anchors(entries, doc_buckets), "answers")
    work.drop()
    cut = blocks.by_bucket(blocks.text_blocks(rows, doc_buckets).union(answers), _cut(cuts, bits))
    found = work.save(blocks.by_bucket(cut, _compare(cuts, ranges)), "found")
    work.drop("answers")
    across = blocks.by_bucket(found.where(F.col("kind") == WINDOWS), _across)
    out = work.save(blocks.spans(found.union(across), WIDTH), "spans")
    work.drop("found")
    return out


def kept_bytes(text: bytes, begins, ends) -> bytes:
    if begins is None or not len(begins):
        return text
    out, at = [], 0
    for b, e in zip(begins, ends):
        out.append(text[at:b])
        at = e
    return b"".join([*out, text[at:]])


def kept_text(text: str, begins, ends) -> str:
    """What is left if each span is shrunk to whole characters."""
    if begins is None or not len(begins):
        return text
    data = text.encode()
    inside = lambda i: i < len(data) and data[i] & 0xC0 == 0x80
    firm = []
    for b, e in zip(begins, ends):
        while inside(b):
            b += 1
        while inside(e):
            e -= 1
        if b < e:
            firm.append((b, e))
    return kept_bytes(data, *zip(*firm)).decode() if firm else text


def _with_spans(docs: DataFrame, id_col: str, text_col: str, bits: int = 64) -> DataFrame:
    return blocks.with_spans(docs, repeated_spans(docs, id_col=id_col, text_col=text_col, bits=bits), id_col, text_col)


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated spans taken out of its texts; a span that begins or
    ends within a character leaves that character whole.  All other columns stay,
    and null texts stay null."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else kept_text(t, b, e) for t, b, e in zip(text, begins, ends)], dtype=object)

    out = _with_spans(docs, id_col, text_col)
    return out.withColumn(text_col, cut(text_col, "_begins", "_ends")).select(*docs.columns)


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """A row (doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``docs``."""

    def each(batches):
        for batch in batches:
            out = [[] for _ in range(4)]
            for text, begins, ends in zip(raw(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                left = kept_bytes(text, begins, ends)
                for column, value in zip(out, (len(text), len(text) - len(left), len(begins or ()), hashlib.sha256(left).hexdigest())):
                    column.append(value)
            types = pa.int64(), pa.int64(), pa.int64(), pa.string()
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, types))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = _with_spans(rows, "doc_id", "text", bits).select("doc_id", "text", "_begins", "_ends")
    return rows.mapInArrow(each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated strings of 50 bytes take from each document."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same in DuckDB, on hexadecimal digits, string by string.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS string FROM (SELECT doc_id, h, unnest(range(strlen(h) // 2 - 49)) AS i FROM d WHERE strlen(h) >= 100)),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY string) AS least FROM s) WHERE doc_id > least),
marks AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM hits),
spans AS (
  SELECT doc_id, min(i) AS b, max(i) + 50 AS e FROM (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM marks) GROUP BY doc_id, n
), ends AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS a FROM spans),
kept AS (
  SELECT doc_id, sum(e - b) AS r, count(*) AS n, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY b) || substr(any_value(h), 2 * max(e) + 1) AS t FROM ends JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(strlen(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(t, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
