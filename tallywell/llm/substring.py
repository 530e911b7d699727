"""Repeated runs of words, by level-wise doubling.

A word goes if a window of ``width`` consecutive words that covers it also starts
in a document with a smaller id.  Level by level, windows that repeat at one
length alone are extended to twice that length, up to ``width`` or until no
candidates survive.  With width 13 the levels are 7 and 13; with 50 they are 7, 14,
28 and 50.

The first level is sampled without loss: of the runs of 7 words in each window of
the next length, the one with the least hash is its anchor, which equal windows
have at the same place, and only anchors are exchanged.  At later levels the
windows that survive are exchanged as contexts: the words of consecutive windows with
one anchor, dealt by the anchor's hash.  Contexts that are equal within what one task
holds are sent for the smallest document alone and the others get their answer at
once, so a passage that very many documents have costs one entry per task.  Where very
many documents have an anchor, whatever stands around it, its windows are dealt one by one.

Hashes only decide where windows meet: there their words are compared (matching.smaller),
so results are exact.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .blocks import ANSWER, ENTRIES, HOT, deal, first_least, mixed, pack, unpack
from .common import Workspace, raw
from .matching import multikey_sort, smaller, spread, stretches

#: Words of a window, and of the first level's runs.
WIDTH, FIRST = 13, 7

_MODULUS = 1 << 64
_WORD = 0xC2B2AE3D27D4EB4F
_SHORT_MASK = np.uint64((1 << blocks.SHORT) - 1)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64, for i under n."""
    out = []
    for b in (base, pow(base, -1, _MODULUS)):
        p = np.full(n, np.uint64(b))
        p[:1] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def _run_hashes(items: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A hash of items[begin:end] for each pair, the same wherever the run stands."""
    up, down = _powers(base, len(items) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(items * up[:-1])])
    return mixed((sums[end] - sums[begin]) * down[begin])


def hashed(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word; what words are equal is decided elsewhere."""
    if not words:
        return np.zeros(0, np.uint64)
    known = pa.array(words, pa.binary()).dictionary_encode()
    return np.fromiter(map(xxhash.xxh64_intdigest, known.dictionary.to_pylist()), np.uint64, len(known.dictionary))[known.indices.to_numpy()]


class Words:
    """The words of some texts, one after the other, and their windows of ``length`` words: where
    each starts (``start``), its anchor of ``first`` words (``anchor``) and the anchor's hash."""

    def __init__(self, texts: list[bytes], first: int, length: int, bits: int = 64):
        parts = [t.split() for t in texts]  # on bytes: exactly at \x20 and \x09-\x0D
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        self.words = list(chain.from_iterable(parts))
        self.doc = np.repeat(np.arange(len(parts)), counts)
        #: Of each text, its first word.
        self.begin = np.cumsum(counts) - counts
        n = max(0, len(self.words) - length + 1)
        self.start = np.flatnonzero(self.doc[:n] == self.doc[length - 1 :]) if n else np.zeros(0, np.int64)
        self.anchor, self.key = self.start, np.zeros(0, np.uint64)
        if len(self.start):
            at = np.arange(len(self.words) - first + 1)
            h = _run_hashes(hashed(self.words), at, at + first, _WORD + 2 * first) & np.uint64((1 << bits) - 1)
            self.anchor = first_least((h >> np.uint64(32)).astype(np.uint32), length - first + 1)[self.start].astype(np.int64)
            self.key = h[self.anchor]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(text's number, key) of each anchor."""
        new = np.ones(len(self.start), bool)
        new[1:] = self.anchor[1:] != self.anchor[:-1]
        return self.doc[self.anchor[new]], self.key[new]

    def contexts(self, kept: np.ndarray, length: int) -> tuple:
        """Of the windows that are kept, consecutive ones with one anchor: (text's number, key,
        anchor's place in its text, least and greatest number of words that a window begins before
        it, the words of all of them joined by spaces)."""
        p, a = self.start[kept], self.anchor[kept]
        if not len(p):
            return p, self.key[:0], p, p, p, []
        new = np.ones(len(p), bool)
        new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)
        begins = np.flatnonzero(new)
        last = np.append(begins[1:], len(p)) - 1
        p1, p2, a = p[begins], p[last], a[begins]
        ends = np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)) + 1)
        joined = b" ".join(self.words)
        low, high = np.concatenate([[0], ends])[p1], ends[p2 + length - 1] - 1
        doc = self.doc[a]
        return doc, self.key[kept][begins], a - self.begin[doc], a - p2, a - p1, [joined[x:y] for x, y in zip(low.tolist(), high.tolist())]


def levels(width: int, first: int) -> list[int]:
    out = [first]
    while out[-1] < width:
        out.append(min(2 * out[-1], width))
    return out


def _extend(length: int, before: int, sampled: bool, last: bool, first: int, hot: np.ndarray, key_buckets: int, bits: int):
    """For a bucket of documents: the entries of its windows of ``length`` words of
    which the parts of ``before`` words survive."""

    def each(bucket, pairs):
        docs = blocks.opened(pairs, by_rid=sampled)
        if not docs.answers:
            return []
        if sampled:
            known = np.unique(np.concatenate([blocks.lengthen(a[1]) for a in docs.answers]))
        else:
            parts = []
            for doc, at, begin, n in docs.answers:
                n = n.astype(np.int64)
                of = doc[np.cumsum(at, dtype=np.int64)].astype(np.uint64) << np.uint64(blocks.SHORT)
                parts.append(np.repeat(of, n) | spread(begin.astype(np.int64), n).astype(np.uint64))
            known = np.unique(np.concatenate(parts))

        def survives(what: np.ndarray) -> np.ndarray:
            return known[np.minimum(np.searchsorted(known, what), len(known) - 1)] == what

        parts, texts = [], []
        for places, got in docs.wanted():
            w = Words(got, first, length, bits)
            if sampled:
                kept = survives(w.key & _SHORT_MASK)
            else:
                doc = w.doc[w.start]
                own = (places[doc].astype(np.uint64) << np.uint64(blocks.SHORT)) | (w.start - w.begin[doc]).astype(np.uint64)
                kept = survives(own) & survives(own + np.uint64(length - before))
            doc, *rest, context = w.contexts(kept, length)
            parts.append((places[doc], *rest))
            texts += context
        if not texts:
            return []
        doc, key, at, near, far = (np.concatenate(x) for x in zip(*parts))
        out = [docs.who(bucket)]
        ids = docs.ids[doc]
        code, least, most = _alike(texts, ids, ids)
        done = np.flatnonzero(ids > least[code] if last else most[code] > least[code])
        if len(done):
            out.append((bucket, ANSWER, blocks.ranges_block(doc[done], at[done] - far[done], at[done] - near[done] + 1)))
        keep = np.flatnonzero(ids == least[code])
        often = keep[np.isin(key[keep] & _SHORT_MASK, hot)]
        rows = [(doc[i], key[i], at[i], near[i], far[i], most[code[i]], texts[i]) for i in np.setdiff1d(keep, often).tolist()] if len(often) else None
        if rows is None:
            return out + _sent(bucket, docs.ids, doc[keep], key[keep], at[keep], near[keep], far[keep], most[code[keep]], [texts[i] for i in keep.tolist()], key_buckets)
        for i in often.tolist():  # each window by itself is a context that begins at its anchor
            words = texts[i].split(b" ")
            for j in range(far[i] - near[i] + 1):
                window = b" ".join(words[j : j + length])
                rows.append((doc[i], np.uint64(xxhash.xxh64_intdigest(window)), at[i] - far[i] + j, 0, 0, most[code[i]], window))
        *columns, texts = zip(*rows)
        return out + _sent(bucket, docs.ids, *map(np.array, columns), list(texts), key_buckets)

    return each


def _alike(contexts: list[bytes], least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each context, equal for equal ones, and the least and the greatest id by number."""
    code = pa.array(contexts, pa.binary()).dictionary_encode().indices.to_numpy()
    order = np.argsort(code, kind="stable")
    begins = blocks.runs(code[order])
    return code, np.minimum.reduceat(least[order], begins), np.maximum.reduceat(most[order], begins)


def _sent(home: int, all_ids: np.ndarray, doc, key, at, near, far, most, contexts: list[bytes], key_buckets: int) -> list[tuple[int, int, bytes]]:
    out = []
    for b, i in deal((mixed(key ^ np.uint64(_WORD)) % np.uint64(key_buckets)).astype(np.int32)):
        used, of = np.unique(doc[i], return_inverse=True)
        held = [contexts[j] for j in i.tolist()]
        sizes = np.fromiter(map(len, held), np.uint32, len(held))
        numbers = of.astype(np.uint32), at[i].astype(np.uint32), near[i].astype(np.uint16), far[i].astype(np.uint16), most[i] - all_ids[doc[i]]
        out.append((b, ENTRIES, pack(home, used.astype(np.uint32), all_ids[used], *numbers, sizes, b"".join(held))))
    return out


def _meet(length: int, first: int, last: bool):
    """For a bucket of contexts: the starts of windows that a smaller document has, or of
    those that any other has."""

    def each(bucket, pairs):
        out, parts, sizes, data = [], [], [], []
        for kind, block in pairs:
            if kind != ENTRIES:
                out.append((bucket, kind, bytes(block)))
                continue
            home, used, ids, of, at, near, far, more, size, joined = unpack(block)
            parts.append((np.full(len(of), home, np.int32), used[of], ids[of], at.astype(np.int64), near.astype(np.int64), far.astype(np.int64), ids[of] + more))
            sizes.append(size)
            data.append(joined)
        if not parts:
            return out
        home, doc, ids, at, near, far, most = (np.concatenate(x) for x in zip(*parts))
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])
        contexts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join(data))])
        del parts, data
        known = contexts.dictionary_encode()
        code = known.indices.to_numpy()
        some = np.zeros(len(known.dictionary), np.int64)
        some[code] = np.arange(len(code))  # a row of each distinct context
        words = pc.split_pattern(known.dictionary, b" ")
        begin = words.offsets.to_numpy().astype(np.int64)
        number = words.flatten().dictionary_encode().indices.to_numpy() + 1
        forward = _matrix(number, begin[:-1] + far[some], begin[1:], np.arange(length))
        backward = _matrix(number, begin[:-1] + far[some], begin[:-1], -1 - np.arange(length - first))
        order, _ = multikey_sort(np.hstack([forward, backward]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        of = rank[code]
        low, high = near[some][order], far[some][order]
        by = np.argsort(of, kind="stable")
        begins = blocks.runs(of[by])
        least, greatest = np.minimum.reduceat(ids[by], begins), np.maximum.reduceat(most[by], begins)
        later, other = smaller(forward[order], backward[order], length, low, high, least, greatest, first)
        offsets = np.arange(length - first + 1)
        marks = (later if last else other) & (low[:, None] <= offsets) & (offsets <= high[:, None])
        got = []
        if last:  # all windows of contexts that a smaller document has too
            i = np.flatnonzero(ids > least[of])
            got.append((home[i], doc[i], at[i] - far[i], at[i] - near[i] + 1))
            by = by[ids[by] == least[of[by]]]
        first_of = np.searchsorted(of[by], np.arange(len(order) + 1))
        c, o1, o2 = stretches(marks)
        n = np.diff(first_of)[c]
        row = by[spread(first_of[c], n)]
        got.append((home[row], doc[row], at[row] - np.repeat(o2, n) + 1, at[row] - np.repeat(o1, n) + 1))
        return out + blocks.range_answers(*(np.concatenate(x) for x in zip(*got)))

    return each


def _matrix(number: np.ndarray, at: np.ndarray, limit: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The numbers at these steps from each place; 0 from the limit on."""
    where = at[:, None] + steps
    inside = where < limit[:, None] if steps[0] == 0 else where >= limit[:, None]
    return np.where(inside, number[np.clip(where, 0, len(number) - 1)], 0).astype(np.int32)


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, first: int = FIRST, bits: int = 64) -> DataFrame:
    """(rid, doc_id, check, begins, ends): for each document with any, the merged half-open spans
    of words covered by windows of ``width`` words that also start in a document with a
    smaller id.  The first three are ``blocks.prepared``'s.

    Words are runs of anything but \\x20 and \\x09-\\x0D, taken as they are.  A null text
    has none.  Rows without an id neither lose words nor cost others any; rows with
    equal ids lose none to each other.  Texts of fewer than ``width`` words lose
    nothing.  No rows give no rows.  ``bits`` are used of anchors' hashes; fewer make more
    work and the same result.
    """
    work = Workspace(docs.sparkSession, "substring")
    rows = blocks.prepared(docs, id_col, text_col)
    size = blocks.total_bytes(rows)
    doc_buckets, key_buckets, context_buckets = (blocks.buckets_for(size, n << 20) for n in (6, 12, 6))
    start = min(first, width - 1)
    _, *longer = levels(width, start)
    entries = blocks.anchor_entries(rows, lambda t: Words(t, start, longer[0], bits).anchors(), doc_buckets, key_buckets)
    answers = work.save(blocks.shared_anchors(entries, doc_buckets, blocks.HOT_DOCUMENTS), f"level{start}")
    work.drop()
    hot = blocks.hot_keys(answers)
    answers = answers.where(F.col("kind") != HOT)
    before, old = start, f"level{start}"
    for length in longer:
        last = length == width
        extend = _extend(length, before, before == start, last, start, hot, context_buckets, bits)
        grown = blocks.by_bucket(blocks.text_blocks(rows, doc_buckets).union(answers), extend)
        answers = work.save(blocks.by_bucket(grown, _meet(length, start, last)), f"level{length}")
        work.drop(old)
        before, old = length, f"level{length}"
        if answers.isEmpty():
            break
    out = work.save(blocks.spans(answers, width), "spans")
    work.drop(old)
    return out


def kept_words(text: bytes, begins, ends) -> list[bytes]:
    out = text.split()  # on bytes: exactly at \x20 and \x09-\x0D
    for b, e in zip(reversed(begins or ()), reversed(ends or ())):
        del out[b:e]
    return out


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, bits: int = 64) -> DataFrame:
    """A row (doc_id, n_words, n_removed, kept_sha256) for each row of ``docs``."""

    def each(batches):
        for batch in batches:
            out = [[] for _ in range(3)]
            for text, begins, ends in zip(raw(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                left = kept_words(text, begins, ends)
                gone = sum(ends or ()) - sum(begins or ())
                for column, value in zip(out, (len(left) + gone, gone, hashlib.sha256(b" ".join(left)).hexdigest())):
                    column.append(value)
            types = pa.int64(), pa.int64(), pa.string()
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, types))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = blocks.with_spans(rows, repeated_spans(rows, width=width, bits=bits), "doc_id", "text").select("doc_id", "text", "_begins", "_ends")
    return rows.mapInArrow(each, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with the repeated words taken out of its texts and the others joined by
    a space; texts that lose nothing, and null ones, stay as they are."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or b is None else b" ".join(kept_words(t.encode(), list(b), list(e))).decode() for t, b, e in zip(text, begins, ends)], dtype=object)

    out = blocks.with_spans(docs, repeated_spans(docs, id_col=id_col, text_col=text_col, width=width), id_col, text_col)
    return out.withColumn(text_col, cut(text_col, "_begins", "_ends")).select(*docs.columns)


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated windows of 13 words take from each document."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same in DuckDB, window by window.
OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents)
), k AS (
  SELECT doc_id, i, array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING), ' ') AS run, i + 12 <= max(i) OVER (PARTITION BY doc_id) AS whole FROM w
), hits AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY run) AS least FROM k WHERE whole) WHERE doc_id > least
), gone AS (SELECT DISTINCT doc_id, i + o.range AS i FROM hits, range(13) AS o),
kept AS (
  SELECT doc_id, count(*) AS n, count(g.i) AS r, coalesce(string_agg(word, ' ' ORDER BY w.i) FILTER (g.i IS NULL), '') AS t FROM w LEFT JOIN (SELECT doc_id AS d, i FROM gone) AS g ON g.d = doc_id AND g.i = w.i GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)
"""
