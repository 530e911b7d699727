"""The near-copy stage's SimHash grid: candidates of its own, each verified."""

from __future__ import annotations

import random

from tallywell.llm import copies, simhash

from .fixtures import table


def test_the_grid_finds_near_copies_and_verifies_them(spark, monkeypatch):
    """With no shared shingles at all to go by, texts within 2 bits still become one group, if they are similar."""
    rng = random.Random(8)
    word = lambda: "w%d" % rng.randrange(9000)
    bits = lambda a, b: (simhash.fingerprint(a.encode(), 5) ^ simhash.fingerprint(b.encode(), 5)).bit_count()
    base = [word() for _ in range(2000)]
    text = " ".join(base)
    near = next(x for x in (" ".join([*base[:i], "edited", *base[i + 1 :]]) for i in range(2000)) if bits(text, x) <= 2)
    same = "again " * 500  # one shingle decides all bits
    one, two = (same + " ".join(word() for _ in range(40)) for _ in range(2))
    assert bits(one, two) == 0
    rows = [(1, text), (2, near), (3, one), (4, two), (5, " ".join(rng.sample(base, 2000)))]
    monkeypatch.setattr(copies, "_keys", lambda unique, words, work: spark.createDataFrame([], "key long, node long, n long, pos long"))
    found, groups = copies.near_copies(table(spark, rows))
    got: dict = {}
    for r in found.select("_row", "doc_id").join(groups, "_row").collect():
        got.setdefault(r._group, set()).add(r.doc_id)
    assert sorted(map(sorted, got.values())) == [[1, 2], [3], [4], [5]]
