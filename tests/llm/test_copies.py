"""Near copies by 5-word shingles, against all pairs."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest

from tallywell.llm import copies

from .fixtures import table


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def plain_groups(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def edited():
    """Texts with copies at all distances, in which a passage is common to many."""
    rng = random.Random(3)
    word = lambda: "w%d" % rng.randrange(5000)
    shared = " ".join(word() for _ in range(30))
    rows = []
    for size in (30, 60, 200, 600):
        base = [word() for _ in range(size)]
        for edits in (0, 1, 1, 2, 3, 4, 5, 6, 8, 10):
            now = list(base)
            for _ in range(edits * size // 150 + (edits > 0)):
                now[rng.randrange(size)] = word()
            rows.append(" ".join(now))
    rows += [shared + " " + " ".join(word() for _ in range(rng.randrange(0, 20))) for _ in range(60)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("crowd", [2, 5, 1000])
def test_near_copies_are_those_of_all_pairs(spark, crowd):
    pairs = edited()
    rows, groups = copies.near_copies(table(spark, pairs), crowd=crowd)
    got: dict = {}
    for r in rows.select("_row", "doc_id").join(groups, "_row").collect():
        got.setdefault(r._group, set()).add(r.doc_id)
    want: dict = {}
    for (i, _), g in zip(pairs, plain_groups(pairs)):
        want.setdefault(g, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert 4 < len(want) < len(pairs)


def test_the_stage_drops_copies_with_several_edits(spark):
    rng = random.Random(5)
    base = ["w%d" % rng.randrange(9000) for _ in range(300)]
    near = list(base)
    for at in (20, 80, 140, 200, 260):  # 25 of 296 shingles differ
        near[at] = "edited"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(rng.sample(base, 300)))]
    kept = corpus_pipeline.drop_near_copies(spark, table(spark, rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_rows_that_share_an_id_are_judged_one_by_one(spark):
    rng = random.Random(6)
    a, b, c = (" ".join("w%d" % rng.randrange(9000) for _ in range(60)) for _ in range(3))
    kept = corpus_pipeline.drop_near_copies(spark, table(spark, [(7, a), (7, b), (7, b), (3, a), (9, c), (None, c)]), "")
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, a), (7, b), (9, c), (None, c)], key=str)
