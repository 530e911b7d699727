"""Which windows of texts are equal, by the order of suffixes.

A context is a place in a text with the items (bytes or words) from there on and
those before it.  Sorted by multikey quicksort, neighbours' longest common prefixes
tell which contexts agree for how long: a window that begins ``o`` items before the
place is equal in two contexts if they share ``width - o`` items from the place on and
``o`` items before it.  Nothing is hashed here, so what is found is exact.
"""

from __future__ import annotations

import numpy as np

#: Segments of so many rows at most are sorted word by word.
SMALL = 4096


def _places(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the segment, and the place, of each place in the segments."""
    length = end - begin
    of = np.repeat(np.arange(len(begin)), length)
    return of, np.arange(len(of)) + np.repeat(begin - (np.cumsum(length) - length), length)


def multikey_sort(words: np.ndarray, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of words, and where in it a new row begins, by multikey quicksort
    (Bentley and Sedgewick, 1997): a segment is split into rows less than, equal to and
    greater than a pivot in one word; equal ones go on with the next word.  All segments
    of a round are split at once; small ones are sorted by one word after the other."""
    n, width = words.shape
    order = np.arange(n)
    begin, end, depth = np.array([0]), np.array([n]), np.array([0])  # segments yet to be sorted
    rest: list[tuple[np.ndarray, ...]] = []
    while True:
        little = end - begin <= small
        rest.append(tuple(x[little & (end - begin > 1)] for x in (begin, end, depth)))
        begin, end, depth = (x[~little] for x in (begin, end, depth))
        if not len(begin):
            break
        of, at = _places(begin, end)
        rows = order[at]
        word = words[rows, depth[of]]
        three = np.sort(np.stack([words[order[p], depth] for p in (begin, (begin + end) // 2, end - 1)]), axis=0)
        pivot = three[1][of]
        side = (word > pivot).astype(np.int8) - (word < pivot)
        # a stable move of each row to its side of its segment
        counts = np.stack([np.bincount(of[side == s], minlength=len(begin)) for s in (-1, 0, 1)])
        first = begin + np.concatenate([np.zeros((1, len(begin)), np.int64), np.cumsum(counts, axis=0)[:-1]])
        for s in (-1, 0, 1):
            mine = np.flatnonzero(side == s)
            seg = of[mine]
            order[first[s + 1][seg] + np.arange(len(mine)) - (np.cumsum(counts[s + 1]) - counts[s + 1])[seg]] = rows[mine]
        last = first + counts
        deeper = depth + 1 < width
        begin = np.concatenate([first[0], first[1][deeper], first[2]])
        end = np.concatenate([last[0], last[1][deeper], last[2]])
        depth = np.concatenate([depth, depth[deeper] + 1, depth])
    begin, end, depth = (np.concatenate(x) for x in zip(*rest))
    while len(begin):
        of, at = _places(begin, end)
        rows = order[at]
        word = words[rows, depth[of]]
        by = np.lexsort((word, of))
        order[at], word = rows[by], word[by]
        cut = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (word[1:] != word[:-1])]))
        upto = np.append(cut[1:], len(of))
        deeper = depth[of[cut]] + 1
        tied = (upto - cut > 1) & (deeper < width)
        begin, end, depth = at[cut[tied]], at[upto[tied] - 1] + 1, deeper[tied]
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = (words[order[1:]] != words[order[:-1]]).any(axis=1)
    return order, new


def big_endian(items: np.ndarray) -> np.ndarray:
    """Rows of bytes as words that sort alike, and rows of other items as they are."""
    if items.dtype != np.uint8:
        return items
    n, width = items.shape
    whole = np.zeros((n, -(-width // 8) * 8), np.uint8)
    whole[:, :width] = items
    return whole.view(">u8").astype(np.uint64)


def common_prefixes(items: np.ndarray) -> np.ndarray:
    """How many items each row has in common with the one before it."""
    lcp = np.zeros(len(items), np.int64)
    if len(items) > 1:
        differ = items[1:] != items[:-1]
        lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), items.shape[1])
    return lcp


def _groups(lcp: np.ndarray, length: int) -> np.ndarray:
    """A number for each row: sorted rows that share ``length`` items have the same."""
    new = lcp < length
    new[:1] = True
    return np.cumsum(new) - 1


def smaller(forward: np.ndarray, backward: np.ndarray, width: int, near: np.ndarray, far: np.ndarray, least: np.ndarray, most: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For distinct contexts in the order of ``forward``: [i, o] tells if the window that begins o items before i's place
    is in a context with a smaller least id; and if it is in one with another id than
    i's least at all.

    ``forward`` has ``width`` items from the place on, ``backward`` those before it, the
    nearest first; windows of i begin from near[i] to far[i] items before it.  Equal
    windows share ``gram`` items from the place on.
    """
    before = backward.shape[1]
    later, other = (np.zeros((len(least), before + 1), bool) for _ in range(2))
    if not len(least):
        return later, other
    other[:] = (most > least)[:, None]
    forward_lcp = common_prefixes(forward)
    alike = _groups(forward_lcp, gram)
    several = np.flatnonzero(np.bincount(alike)[alike] > 1)
    if not len(several):
        return later, other
    back_order, _ = multikey_sort(big_endian(backward[several]))
    back_lcp = common_prefixes(backward[several][back_order])
    back = np.empty(len(several), np.int64)
    low, high = least[several], most[several]
    for o in range(before + 1):
        mine = np.flatnonzero((near[several] <= o) & (o <= far[several]))
        if len(mine) < 2:
            continue
        back[back_order] = _groups(back_lcp, o)
        key = _groups(forward_lcp, width - o)[several[mine]] * len(several) + back[mine]
        order = np.argsort(key, kind="stable")
        key, mine = key[order], mine[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        begins = np.flatnonzero(new)
        lengths = np.diff(begins, append=len(key))
        first = np.repeat(np.minimum.reduceat(low[mine], begins), lengths)
        last = np.repeat(np.maximum.reduceat(high[mine], begins), lengths)
        later[several[mine], o] = low[mine] > first
        other[several[mine], o] = last > first
    return later, other


def stretches(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, column after the last) of each run of marks."""
    edges = np.diff(np.pad(marks, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (row, begin), (_, end) = np.nonzero(edges == 1), np.nonzero(edges == -1)
    return row, begin, end


def spread(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each of the ranges."""
    return np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())
