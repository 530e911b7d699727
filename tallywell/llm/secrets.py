"""Scanning texts for secrets through a trigram index.

From the parsed form of each rule's regular expression a Boolean query over
trigrams is derived, which every text with a match satisfies (after Cox, 2012): an
"or" over alternatives of an "and" over the trigrams of their literal parts.
For a block of documents postings, as bitmaps, of the trigrams in those queries
are made in one pass over its bytes; the queries are evaluated by intersecting
and uniting postings, and only the documents found are scanned by the regular
expression.  A rule without mandatory trigrams scans every document.

Trigrams are over bytes with A-Z lower-cased, for all rules; that can only find
more candidates.  Blocks are independent, so nothing is shuffled or gathered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from re import _constants as _c
from re import _parser as _p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import configure, slices, texts

#: Bytes of text in a block.
BLOCK_BYTES = 4 << 20
#: A regular expression with more alternatives than this is cut at the place that has them.
MOST_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  Its spans are the leftmost non-overlapping matches of
    ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    least: int = 0

    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, self.flags)

    def spans(self, text: str, regex: re.Pattern) -> list[tuple[int, int]]:
        return [m.span() for m in regex.finditer(text) if len(m[self.group]) >= self.least]


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
)
#: Further kinds, from the public descriptions of these tokens.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE + MORE

#: A query: any of these sets must be there as a whole.  None: no condition.
Query = frozenset[frozenset[bytes]] | None


def _literals(node, ignore_case: bool) -> list[list[str | None]]:
    """Alternatives, each a list of literal characters with None for anything else."""
    out: list[list[str | None]] = [[]]
    for op, arg in node:
        if op is _c.LITERAL:
            parts = [[chr(arg)]]
        elif op is _c.IN and len(arg) <= 8 and all(k is _c.LITERAL for k, _ in arg):
            parts = [[chr(v)] for _, v in arg]
        elif op is _c.SUBPATTERN:
            parts = _literals(arg[-1], ignore_case)
        elif op is _c.BRANCH:
            parts = [x for branch in arg[1] for x in _literals(branch, ignore_case)]
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
            low, high, inner = arg
            once = _literals(inner, ignore_case)
            if low == high == 1:
                parts = once
            elif low == 0 and high == 1:
                parts = [[], *once]
            elif low >= 1 and len(once) == 1:
                parts = [once[0] * min(low, 8) + ([] if low == high <= 8 else [None, *once[0]])]
            elif low >= 1:
                parts = [[None]] if len(once) > MOST_ALTERNATIVES else [[None, *x, None] for x in once]
            else:
                parts = [[None]]
        elif op is _c.AT:
            parts = [[]]
        else:
            parts = [[None]]
        if len(out) * len(parts) > MOST_ALTERNATIVES:
            parts = [[None]]
        out = [a + b for a in out for b in parts]
    return out


def trigram_query(pattern: str, flags: int = re.ASCII) -> Query:
    """The trigrams of which a text that ``pattern`` matches has all of some set; None
    if some alternative has no trigram, so that every text must be scanned."""
    sets = set()
    for chain in _literals(_p.parse(pattern, flags), bool(flags & re.IGNORECASE)):
        need = set()
        for run in "".join("\0" if c is None else c for c in chain).split("\0"):
            data = run.encode().lower()
            need |= {data[i : i + 3] for i in range(len(data) - 2)}
        if not need:
            return None
        sets.add(frozenset(need))
    return frozenset(s for s in sets if not any(t < s for t in sets))


class Index:
    """Postings of the trigrams in ``queries`` over one block of documents."""

    def __init__(self, queries: Sequence[Query]):
        grams = sorted({g for q in queries if q for s in q for g in s})
        self.slot = np.zeros(1 << 24, np.uint16)
        for i, g in enumerate(grams):
            self.slot[int.from_bytes(g, "big")] = i + 1
        self.place = {g: i for i, g in enumerate(grams)}
        self.lower = np.arange(256, dtype=np.uint32)
        self.lower[ord("A") : ord("Z") + 1] += 32

    def postings(self, docs: list[str]) -> np.ndarray:
        """[trigram, document] tells if the document has the trigram."""
        parts = [d.encode() for d in docs]
        buf = self.lower[np.frombuffer(b"\0\0".join([*parts, b"", b""]), np.uint8)]
        found = self.slot[(buf[:-2] << np.uint32(16)) | (buf[1:-1] << np.uint32(8)) | buf[2:]]
        at = np.flatnonzero(found)
        ends = np.cumsum(np.fromiter((len(p) + 2 for p in parts), np.int64, len(parts)))
        out = np.zeros((len(self.place), len(docs)), bool)
        out[found[at].astype(np.int64) - 1, np.searchsorted(ends, at, "right")] = True
        return out

    def candidates(self, query: Query, postings: np.ndarray) -> np.ndarray:
        n = postings.shape[1]
        if query is None:
            return np.arange(n)
        hits = np.zeros(n, bool)
        for need in query:
            hits |= np.logical_and.reduce([postings[self.place[g]] for g in need])
        return np.flatnonzero(hits)


def scanner(rules: Sequence[Rule]) -> Callable[[list[str]], list[list[tuple[int, int, int]]]]:
    """A function from the texts of a block to the (start, rule's number, end) of each
    text's spans, sorted."""
    queries = [trigram_query(r.pattern, r.flags) for r in rules]
    regexes = [r.regex() for r in rules]
    index = Index(queries)

    def scan(docs: list[str]) -> list[list[tuple[int, int, int]]]:
        out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
        postings = index.postings(docs)
        for k, (rule, query, regex) in enumerate(zip(rules, queries, regexes)):
            for i in index.candidates(query, postings):
                out[i] += [(a, k, b) for a, b in rule.spans(docs[i], regex)]
        for found in out:
            found.sort()
        return out

    return scan


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return slices(batches, "text", BLOCK_BYTES)


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (doc_id, spans) for each row of ``docs``: spans is an array of structs of
    kind, start and end (code points, end exclusive) by start, then kind as in
    ``rules``.  Null and empty texts have none; rows without an id and repeated rows
    are scanned like any other."""
    configure(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def each(batches):
        scan = scanner(rules)
        for batch in _blocks(batches):
            found = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in x] for x in scan(texts(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(each, "doc_id long, spans array<struct<kind: string, start: int, end: int>>")


def redacted(text: str, spans: Sequence[tuple[int, int, int]], rules: Sequence[Rule]) -> str:
    """``text`` with each secret replaced by its kind in square brackets; spans that
    overlap go together, under the first one's kind."""
    out, at, i = [], 0, 0
    while i < len(spans):
        a, k, b = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < b:
            b = max(b, spans[i][2])
            i += 1
        out += [text[at:a], f"[{rules[k].kind}]"]
        at = b
    return "".join([*out, text[at:]])


def without_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, *, text_col: str = "text") -> DataFrame:
    """``docs`` with its secrets redacted; all other columns, and null texts, stay."""
    configure(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scan = scanner(rules)
        for part in parts:
            got = part.tolist()
            out, begin, held = [], 0, 0
            for i, t in enumerate([*got, None]):
                if i == len(got) or held > BLOCK_BYTES:
                    block = [t or "" for t in got[begin:i]]
                    out += [None if t is None else redacted(t, s, rules) if s else t for t, s in zip(got[begin:i], scan(block))]
                    begin, held = i, 0
                held += len(t or "")
            yield pd.Series(out, dtype=object)

    return docs.withColumn(text_col, clean(text_col)).select(*docs.columns)


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns, from ``find_secrets``'s spans."""

    def joined(spans) -> str:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    base = F.filter("spans", lambda s: s.kind.isin([r.kind for r in BASE]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    found = find_secrets(docs, id_col=id_col, text_col=text_col)
    return found.select(
        "doc_id", *(count(r.kind) for r in BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
