from __future__ import annotations

import math

import numpy as np
import pytest

from tallywell.llm import ann, urls

from .fixtures import counted

SCHEMA = "vec_id long, embedding array<float>, label int, ids string, shard int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA)


def plain(rows, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    out = []
    for q, x in good:
        if q % 100 == 0:
            near = sorted((float(ann.distances(x[None], v[None])[0]), i) for i, v in good if i != q)[:k]
            out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    return out


@pytest.mark.parametrize("block", [8192, 50])
def test_recall_and_scores(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK_ROWS", block)
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(32).astype(np.float32).tolist()) for i in range(900)]
    rows += [(i, rows[3][1]) for i in range(1000, 1030)]  # copies: ties go to the smaller id
    rows += [(1100, None), (1200, []), (1300, [0.0] * 32), (1400, [math.nan] * 32), (1500, [math.inf] * 32), (1600, [None] * 32), (None, rows[0][1])]
    docs = frame(spark, rows)
    got = ann.search(docs, docs.where("vec_id % 100 = 0")).collect()
    want = plain(rows, 10)
    assert len(got) == len(want)
    hits = len({(r.query_id, r.vec_id) for r in got} & {(q, i) for q, _, i, _ in want})
    assert hits >= 0.98 * len(want)
    by = {(q, i): d for q, _, i, d in plain(rows, 10_000)}
    assert all(r.score == by[r.query_id, r.vec_id] for r in got)


def test_bounds_hold():
    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((2000, 48)) + 1
    model = ann.fit(np.arange(2000), vectors)
    low, high = ann.bounds(model, *ann.encode(model, vectors), vectors[:50], ann.ERRORS)
    exact = ((vectors[:50, None] - vectors[None]) ** 2).sum(axis=2)
    inside = (low <= exact + 1e-6) & (exact <= high + 1e-6)
    assert inside.mean() > 0.999
    assert (high - low).mean() < 2 * exact.mean()  # and they tell something


def test_few_and_none(spark):
    docs = frame(spark, [(0, [1.0, 2.0]), (1, [1.0, 3.0]), (2, [5.0, 5.0, 5.0])])
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(docs, docs.where("vec_id = 0")).collect()] == [(0, 1, 1, 1.0)]
    assert ann.search(docs.where("false"), docs).collect() == []
    assert ann.search(docs, docs.where("false")).collect() == []


URLS = [
    (1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "http://EXAMPLE.com/en/x?y#z"), (6, "https://www.example.com/en/"), (7, "https://a.www.example.com/en/q"), (8, "http://com"),
    (9, "http://com/"), (10, "http://notexample.com/en/1"), (11, "ftp://x.net/es/"), (12, "http://x.net/es"), (13, "http://x.org/fr/"), (14, "http://example.com?u=http://y.net/fr/"),
    (15, "http://a.b.c.d.e.net/fr/" + "x" * 5000), (15, "http://x.net/fr/"), (15, "http://x.net/fr/"), (16, "http://é.com/É"), (17, "a://b://net/es/"), (18, "http://.com/x\ny"), (None, "http://net/es/"),
]


def plain_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host + r.path), r.action == "block"), default=None)
    return host, path, best and best.host + best.path, best.action if best else "allow"


@pytest.mark.parametrize("limit", [10_000, 0])
def test_urls(spark, monkeypatch, limit):
    monkeypatch.setattr(urls, "BROADCAST_RULES", limit)
    pages = spark.createDataFrame([(i, u, "old", "old", "h") for i, u in URLS], "page_id long, url string, host string, rule string, html string")
    got = urls.verdicts(pages)
    assert got.columns == ["page_id", "url", "html", "host", "path", "rule", "verdict"]
    want = [(i, *plain_verdict(u, urls.RULES)) for i, u in URLS]
    assert counted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()) == counted(want)
    assert urls.verdicts(pages.where("false")).collect() == []
    more = (*urls.RULES, urls.Rule("block", "d.e.net", "/f"), urls.Rule("allow", "x.net", "/fr/"), urls.Rule("block", "x.net", "/fr/"))
    got = urls.verdicts(pages, more).collect()
    assert counted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == counted((i, *plain_verdict(u, more)) for i, u in URLS)


@pytest.mark.parametrize("shard_bytes", [64 << 20, 20_000])
def test_repeated_ids_and_lengths(spark, monkeypatch, shard_bytes):
    """Each pair of rows counts, whatever ids repeat; each length is searched by itself; the grid
    has many shards either way or few."""
    monkeypatch.setattr(ann, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    monkeypatch.setattr(ann, "QUERY_ROWS", 8)
    rng = np.random.default_rng(9)
    rows = [(100 * i if i % 3 == 0 else i, rng.standard_normal(24 if i % 4 else 16).tolist()) for i in range(600)]
    rows += rows[:40] + [(5, r) for _, r in rows[50:60]] + [(300, rows[1][1])]
    rows = [(i, np.array(v, np.float32).tolist()) for i, v in rows]
    docs = frame(spark, rows)
    got = ann.search(docs, docs.where("vec_id % 100 = 0")).collect()
    pairs: dict = {}
    for q, x in rows:
        if q % 100 == 0:
            pairs.setdefault((q, len(x)), []).extend((float(ann.distances(np.array([x]), np.array([v]))[0]), i) for i, v in rows if i != q and len(v) == len(x))
    want = [(q, r + 1, i, d) for (q, _), near in pairs.items() for r, (d, i) in enumerate(sorted(near)[:10])]
    assert counted(got) == counted(want)


def test_popcounts_are_inner_products():
    rng = np.random.default_rng(10)
    vectors = rng.standard_normal((300, 40))
    model = ann.fit(np.arange(300), vectors)
    codes, length, inner = ann.encode(model, vectors)
    signs = np.unpackbits(codes, axis=1, count=model.bits) * 2.0 - 1
    low, high = ann.bounds(model, codes, length, inner, vectors[:20], ann.ERRORS)
    residual = vectors[:20] - model.centre
    product = (residual @ model.turn) @ signs.T / np.sqrt(model.bits)
    own = (residual**2).sum(axis=1)[:, None]
    assert np.abs((low + high) / 2 - (own + length**2 - 2 * product / inner * length)).max() < 0.15 * own.max()
