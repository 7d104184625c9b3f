"""Blockwise suffix sorting with a difference cover (numpy).

A set D is a difference cover modulo V if every difference modulo V is one of two
members of D.  The ranks of the suffixes that start at positions p with p mod V in D
are computed once.  Any other suffixes are then sorted one bucket at a time by their
first V bytes; two that tie there are compared by the ranks of the sample suffixes
that start the same few bytes after both, so no comparison looks further and the
working memory is that of one bucket.
"""

from __future__ import annotations

from functools import cmp_to_key

import numpy as np

V = 32


def difference_cover(v: int) -> list[int]:
    """A small cover found greedily: each step adds the residue that covers most new differences."""
    cover, missing = [0], set(range(1, v))
    while missing:
        gain = {d: len(missing & ({(d - c) % v for c in cover} | {(c - d) % v for c in cover})) for d in range(v) if d not in cover}
        best = max(gain, key=lambda d: (gain[d], -d))
        missing -= {(best - c) % v for c in cover} | {(c - best) % v for c in cover}
        cover.append(best)
    return sorted(cover)


COVER = difference_cover(V)
IN_COVER = np.isin(np.arange(V), COVER)
#: STEP[r]: bytes from a position of residue r to the next cover position.
STEP = np.array([next(d for d in range(V) if IN_COVER[(r + d) % V]) for r in range(V)], dtype=np.int64)
#: PAIR[r, s]: least d such that r + d and s + d are both residues of the cover.
PAIR = np.array([[next(d for d in range(V) if IN_COVER[(r + d) % V] and IN_COVER[(s + d) % V]) for s in range(V)] for r in range(V)], dtype=np.int64)


def words(text: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as one big-endian number; zeros follow the text."""
    n = len(text)
    padded = np.zeros(n + 8, dtype=np.uint8)
    padded[:n] = text
    out = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        out <<= np.uint64(8)
        out |= padded[k : k + n]
    return out


def at(w: np.ndarray, where: np.ndarray) -> np.ndarray:
    out = w[np.minimum(where, len(w) - 1)]
    out[where >= len(w)] = 0
    return out


def by_prefix(w: np.ndarray, where: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts positions by their first `size` bytes: order, and the dense number of each sorted entry's prefix."""
    keys = [at(w, where + k) for k in range(0, size, 8)]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(where), dtype=bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new)


def cover_ranks(text: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the suffixes at cover positions, by prefix doubling in steps of V.

    Returns (slot, rank): slot maps position // V and residue to an index of rank.
    Position p + V * 2**k is in the sample if p is, so each round joins two known ranks.
    """
    n = len(text)
    index_in = np.cumsum(IN_COVER) - 1
    blocks = -(-n // V) + 1
    where = (np.arange(blocks)[:, None] * V + np.array(COVER)[None, :]).ravel()
    order, number = by_prefix(w, where, V)
    rank = np.empty(len(where), dtype=np.int64)
    rank[order] = number + 1
    rank[where >= n] = 0
    step, c = 1, len(COVER)
    groups = number[-1] + 1 if len(number) else 0
    # Only tied entries take part in a further round.
    while groups < len(where):
        tied = np.flatnonzero(np.bincount(rank, minlength=rank.max() + 1)[rank] > 1)
        tied = tied[rank[tied] > 0]
        if not len(tied):
            break
        later = tied + step * c
        second = np.where(later < len(where), rank[np.minimum(later, len(where) - 1)], 0)
        first = rank[tied]
        o = np.lexsort((second, first))
        f, s = first[o], second[o]
        starts = np.r_[True, f[1:] != f[:-1]]
        differ = starts | np.r_[True, s[1:] != s[:-1]]
        if differ.sum() == starts.sum() and step * V > n:
            break
        # A group's ranks stay within the gap below it: ranks are first made positions of the sorted sample.
        if step == 1:
            counts = np.bincount(rank)
            rank = np.cumsum(counts)[rank] - counts[rank] + 1
            rank[where >= n] = 0
            f = rank[tied][o]
        at_start = np.maximum.accumulate(np.where(differ, np.arange(len(o)), 0))
        group_start = np.maximum.accumulate(np.where(starts, np.arange(len(o)), 0))
        rank[tied[o]] = f + (at_start - group_start)
        step *= 2
        if step * V > n:
            break
    return index_in, rank


def rank_at(index_in: np.ndarray, rank: np.ndarray, where: np.ndarray) -> np.ndarray:
    return rank[(where // V) * len(COVER) + index_in[where % V]]


def sort_suffixes(text: np.ndarray, where: np.ndarray | None = None, bucket: int = 1 << 20):
    """Yields the given suffix positions (all by default) in suffix order, one bucket at a time.

    Every suffix is taken as followed by zero bytes, then by its end: at the end of the
    text the shorter suffix comes first.  Buckets are ranges of the first eight bytes;
    a range that holds one single value may be larger than `bucket`.
    """
    where = np.arange(len(text), dtype=np.int64) if where is None else np.asarray(where, dtype=np.int64)
    if not len(where):
        return
    w = words(text)
    index_in, rank = cover_ranks(text, w)
    first = w[where]
    cuts = np.unique(np.sort(first)[::bucket])
    home = np.searchsorted(cuts, first, side="right")
    for k in range(1, len(cuts) + 1):
        inside = where[home == k] if len(cuts) > 1 else where
        if len(inside):
            yield _sorted_bucket(w, index_in, rank, inside)


def _sorted_bucket(w, index_in, rank, inside):
    order, number = by_prefix(w, inside, V)
    out = inside[order]
    if not len(number) or number[-1] + 1 == len(out):
        return out
    sizes = np.bincount(number)
    tied = np.flatnonzero(sizes[number] > 1)
    pos, group = out[tied], number[tied]
    residue = pos % V
    # Suffixes of one residue have one distance to the cover; groups that mix residues are compared pair by pair.
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    mixed = np.repeat(np.minimum.reduceat(residue, starts) != np.maximum.reduceat(residue, starts), np.diff(np.r_[starts, len(group)]))
    key = rank_at(index_in, rank, pos + STEP[residue])
    o = np.lexsort((key, group))
    out[tied] = pos[o]
    for g in np.unique(group[mixed]):
        lo, hi = np.searchsorted(number, g), np.searchsorted(number, g, side="right")

        def compare(i: int, j: int) -> int:
            d = PAIR[i % V, j % V]
            x, y = rank_at(index_in, rank, np.array([i + d, j + d]))
            return int(x > y) - int(x < y) or int(i < j) - int(i > j)

        out[lo:hi] = sorted(out[lo:hi].tolist(), key=cmp_to_key(compare))
    return out
