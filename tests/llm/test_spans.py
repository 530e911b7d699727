"""Suffix-array and substring duplicates against brute force."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallywell.llm import blocks, substring, suffix

from .fixtures import counted, table, texts


def brute(rows, width, split):
    parts = [(i, split(t)) for i, t in rows]
    first: dict = {}
    for i, p in parts:
        if i is not None:
            for k in range(len(p) - width + 1):
                key = p[k : k + width] if isinstance(p, bytes) else tuple(p[k : k + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, p in parts:
        gone = bytearray(len(p))
        for k in range(len(p) - width + 1):
            key = p[k : k + width] if isinstance(p, bytes) else tuple(p[k : k + width])
            if i is not None and first[key] < i:
                gone[k : k + width] = b"\1" * width
        out.append((i, p, gone))
    return out


def test_suffix_digests(spark):
    rows = texts()
    want = []
    for i, t, gone in brute(rows, 50, lambda t: (t or "").encode()):
        kept = bytes(b for b, g in zip(t, gone) if not g)
        want.append((i, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    assert counted(suffix.digests(table(spark)).collect()) == counted(want)


@pytest.mark.parametrize("size", [20_000, 60_000])
def test_suffix_many_buckets(spark, monkeypatch, size):
    """The same with text spread over many buckets and ranges."""
    monkeypatch.setattr(blocks, "buckets_for", lambda total, each: max(1, total // size))
    rows = texts(2)
    want = {(i, sum(gone)) for i, _, gone in brute(rows, 50, lambda t: (t or "").encode())}
    got = suffix.digests(table(spark, rows)).select("doc_id", "n_removed").collect()
    assert {tuple(r) for r in got} == want


def test_suffix_common_tokens(spark, monkeypatch):
    """The same with every token, or some, taken for a common one."""
    monkeypatch.setattr(blocks, "buckets_for", lambda total, each: max(1, total // 40_000))
    plain = suffix._splitters
    for part in (1, 2):
        monkeypatch.setattr(suffix, "_splitters", lambda rows, ranges, n: (lambda s: (s, np.unique(suffix_tokens(texts(2))[::part])))(plain(rows, ranges, n)[0]))
        rows = texts(2)
        want = {(i, sum(gone)) for i, _, gone in brute(rows, 50, lambda t: (t or "").encode())}
        got = suffix.digests(table(spark, rows)).select("doc_id", "n_removed").collect()
        assert {tuple(r) for r in got} == want


def suffix_tokens(rows):
    data = [(t or "").encode() for _, t in rows]
    _, _, a, _, _, buf, _ = suffix.anchors(data)
    return np.array([bytes(buf[x : x + suffix.LEAD]) for x in a], f"S{suffix.LEAD}")


@pytest.mark.parametrize("width,first", [(13, 7), (9, 7), (50, 7)])
def test_substring(spark, width, first):
    rows = texts(3)
    want = {(i, sum(gone)) for i, _, gone in brute(rows, width, lambda t: (t or "").encode().split())}
    found = substring.digests(table(spark, rows), width=width).select("doc_id", "n_removed").collect()
    assert {tuple(r) for r in found} == want


def test_substring_digests(spark):
    rows = texts()
    want = []
    for i, w, gone in brute(rows, 13, lambda t: (t or "").encode().split()):
        want.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    assert counted(substring.digests(table(spark)).collect()) == counted(want)


def test_empty(spark):
    empty = table(spark).where("false")
    assert suffix.digests(empty).collect() == [] and substring.digests(empty).collect() == []
    assert suffix.without_repeats(empty).collect() == []


def test_text_stays_whole(spark):
    """Texts that lose bytes stay valid, and the other columns stay as they were."""
    docs = table(spark)
    out = suffix.without_repeats(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[3] is None and got[2].startswith("intro ") and len(got[15]) < 50
    words = {r.doc_id: r.text for r in substring.without_repeats(docs).collect()}
    assert words[3] is None and words[9] == "" and words[7] == "two words"


def test_kept_text_on_characters():
    assert suffix.kept_text("aéb", [2], [3]) == "aéb"
    assert suffix.kept_text("aéb", [0], [2]) == "éb"
    assert suffix.kept_bytes(b"abcdef", [1, 4], [2, 6]) == b"acd"


@given(st.lists(st.binary(min_size=0, max_size=160), max_size=6))
@settings(max_examples=60, deadline=None)
def test_anchors_cover_all_windows(parts):
    doc, key, a, p1, p2, buf, starts = suffix.anchors(parts)
    windows = sum(max(0, len(p) - 49) for p in parts)
    assert (p2 - p1 + 1).sum() == windows
    assert ((p1 <= a) & (a + suffix.GRAM <= p1 + suffix.WIDTH) | (p2 > p1)).all()
    for d, x in zip(doc, a):
        assert starts[d] <= x < starts[d + 1]


@given(st.lists(st.lists(st.integers(0, 3), min_size=3, max_size=3), min_size=1, max_size=40))
@settings(deadline=None)
def test_multikey_sort(rows):
    words = np.array(rows, np.uint64)
    order, new = suffix.multikey_sort(words)
    got = [tuple(words[i]) for i in order]
    assert got == sorted(map(tuple, words.tolist()))
    assert [True, *(a != b for a, b in zip(got, got[1:]))] == new.tolist()


def few_tags(doc_id, text):
    """Tags of which many documents share each."""
    from pyspark.sql import functions as F

    return F.pmod(F.xxhash64(doc_id, text), F.lit(3)), F.pmod(F.xxhash64(text), F.lit(5))


@pytest.mark.parametrize("buckets", [1, 3])
def test_weak_hashes_change_nothing(spark, monkeypatch, buckets):
    """Hashes of few bits, and documents that can't be told apart by rid: the same result."""
    monkeypatch.setattr(blocks, "buckets_for", lambda total, each: buckets)
    rows = texts(4)
    small = table(spark, rows)
    want = {(i, sum(gone)) for i, _, gone in brute(rows, 50, lambda t: (t or "").encode())}
    assert {tuple(r) for r in suffix.digests(small, bits=3).select("doc_id", "n_removed").collect()} == want
    want = {(i, sum(gone)) for i, _, gone in brute(rows, 13, lambda t: (t or "").encode().split())}
    assert {tuple(r) for r in substring.digests(small, bits=3).select("doc_id", "n_removed").collect()} == want


def test_documents_with_equal_rids(spark, monkeypatch):
    rows = [(i, t) for i, t in texts(5) if i != 22]  # ids and check must still tell documents apart
    monkeypatch.setattr(blocks, "tags", lambda doc_id, text: (few_tags(doc_id, text)[0], blocks.F.xxhash64(text)))
    small = table(spark, rows)
    want = {(i, sum(gone)) for i, _, gone in brute(rows, 50, lambda t: (t or "").encode())}
    assert {tuple(r) for r in suffix.digests(small).select("doc_id", "n_removed").collect()} == want
    want = {(i, sum(gone)) for i, _, gone in brute(rows, 13, lambda t: (t or "").encode().split())}
    assert {tuple(r) for r in substring.digests(small).select("doc_id", "n_removed").collect()} == want


@pytest.mark.parametrize("width", [13, 30])
def test_hot_anchors_are_dealt_by_window(spark, monkeypatch, width):
    monkeypatch.setattr(blocks, "HOT_DOCUMENTS", 2)
    monkeypatch.setattr(blocks, "buckets_for", lambda total, each: 3)
    rows = texts(6)
    want = {(i, sum(gone)) for i, _, gone in brute(rows, width, lambda t: (t or "").encode().split())}
    assert {tuple(r) for r in substring.digests(table(spark, rows), width=width).select("doc_id", "n_removed").collect()} == want


def test_words_that_polynomials_confuse(spark):
    """A Thue-Morse word and its complement are equal modulo 2 ** 64 under any odd multiplier."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    same = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{same} {word}"), (2, f"{same} {word.translate(str.maketrans('ab', 'ba'))}"), (3, f"{same} {word}")]
    assert {tuple(r) for r in substring.digests(table(spark, rows)).select("doc_id", "n_removed").collect()} == {(1, 0), (2, 0), (3, 13)}


def test_suffixes_across_ranges(spark, monkeypatch):
    """One gram in every document, cut into many ranges: windows meet beyond the ends."""
    monkeypatch.setattr(blocks, "buckets_for", lambda total, each: 12)
    gram = "the same leading token, always "
    rows = [(i, f"{i:04d}{'xyz'[i % 3] * (i % 17)} {gram}{'pq'[i % 2] * (i % 13 + 6)}{i % 5} tail {i % 7} " * 3) for i in range(90)]
    cuts = sorted({f"{gram}{c * n}".encode()[:50] for c in "pq" for n in range(1, 19)} | {gram[:k].encode() for k in (5, 16, 24)})
    monkeypatch.setattr(suffix, "_splitters", lambda rows, ranges, n: (np.array(cuts, "S50")[::4], np.array(cuts, "S50")[::5]))
    want = {(i, sum(gone)) for i, _, gone in brute(rows, 50, lambda t: (t or "").encode())}
    assert {tuple(r) for r in suffix.digests(table(spark, rows)).select("doc_id", "n_removed").collect()} == want


@given(st.lists(st.lists(st.integers(0, 2), min_size=4, max_size=4), min_size=1, max_size=80), st.integers(1, 9))
@settings(deadline=None)
def test_multikey_quicksort_splits(rows, small):
    words = np.array(rows, np.uint64)
    order, new = suffix.multikey_sort(words, small)
    got = [tuple(x) for x in words[order].tolist()]
    assert got == sorted(got) and sorted(order.tolist()) == list(range(len(rows)))
    assert [True, *(a != b for a, b in zip(got, got[1:]))] == new.tolist()
