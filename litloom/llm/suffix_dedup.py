"""Removal of byte strings that an earlier document already holds (operator 9).

Every string of `length` bytes that also starts in a document with a smaller doc_id is
removed from the later document.  Three steps, all keyed by hashes that spread evenly:

1. Anchors.  Among the K-grams inside a string of `length` bytes the one with the least
   hash (leftmost on ties) is its anchor: equal strings have the same anchor at the same
   offset.  Documents are dealt to groups; each group sends every anchor's hash once to the
   group of that hash, with a sign whether several of its documents have it.  Hashes seen in
   one document alone are dropped, and with them every string that cannot repeat.
2. Contexts.  For each anchor left, a group of documents sends the bytes of the strings it
   is the anchor of to the group of the anchor's hash.  Of equal contexts with the anchor at
   the same place only those of the least doc_id are sent; the others are removed whole, as
   that document holds all their strings.  So a passage that every document holds reaches its
   group once from each group of documents, not once from each document.  Contexts at the
   passage's ends go on into each document's own text and differ; so the strings of an anchor
   that more than `hot` texts have are dealt one by one, by a hash of the string.  Equal contexts
   that meet are merged again, laid out as one text, and their suffixes are sorted blockwise with a
   difference cover (suffix_array.py).  Neighbours that agree on `length` bytes form a run;
   a member is removed if a document of the run has a smaller id.
3. The removed intervals, united, go back to the groups of their documents and are cut out.

Groups hold GROUP_BYTES of text, more by the fourth root beyond GROW_BYTES of input, so what
a common passage sends grows slower than the input.

Texts that repeat as a whole are settled before step 1: all but the first copy lose
everything, so a large group of copies never meets in a task.  A text is known by two
64-bit hashes of different seeds and its size.

Defined cases: a null text is empty; a text shorter than `length` loses nothing; a null
doc_id is smaller than any other; rows with the same doc_id never remove from each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litloom.llm.common import NULL_ID, partitions_for, table
from litloom.llm.workers import over_batches, over_groups
from litloom.llm.suffix_array import V, at, sort_suffixes, words

LENGTH = 50
K = 16
#: Bytes of text that one group of documents holds, and that one group's contexts may hold.
GROUP_BYTES = 8 << 20
GROW_BYTES = 64 << 30
#: Different texts with one anchor beyond which its strings are dealt by their own hashes.
HOT_DOCS = 20_000
PIECE = 1 << 19
#: Contexts whose anchors are gathered at once.
SOME = 1 << 15
#: Bytes of contexts sorted at once; the sort and what it tells of them take many times as much.
SORT_BYTES = 1 << 19

#: From a group of documents (home) to a group of hashes (pt): hashes one document or several have.
HASHES = "pt int, home int, one binary, many binary, times binary"
#: Contexts: number of the document in its group, its id, where the first string starts, number of strings, the anchor's place in it, bytes.
CONTEXTS = ("who", "did", "start", "n", "off", "ctx")
BLOB = "pt int, home int, " + ", ".join(f"{c} binary" for c in CONTEXTS) + ", marks binary"
MARKS = "pt int, marks binary"
#: A removed interval of a document.
MARK = np.dtype([("who", "<u4"), ("a", "<u4"), ("b", "<u4")])
SPAN = np.int64(1) << 40


def _hashes(buf: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the K bytes at each position, by doubling."""
    h = buf.astype(np.uint64) + np.uint64(1)
    for k, m in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9), (8, 0xD6E8FEB86659FD93)):
        h = h[:-k] * np.uint64(m) + h[k:]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def anchor_runs(buf: np.ndarray, owner: np.ndarray | None, length: int):
    """Runs of string starts that share an anchor: (hash, start, number of starts, anchor - start).

    owner: number of the document at each byte; strings that cross documents are left out.
    """
    n = len(buf) - length + 1
    if n <= 0:
        return (np.empty(0, np.uint64),) + (np.empty(0, np.int64),) * 3
    h = _hashes(buf)
    span = length - K + 1
    m = (h & ~np.uint64(0xFFFFF)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if span > width:
        m = np.minimum(m[: len(m) - (span - width)], m[span - width :])
    p = (m[:n] & np.uint64(0xFFFFF)).astype(np.int64)
    change = np.empty(n, dtype=bool)
    change[0] = True
    np.not_equal(p[1:], p[:-1], out=change[1:])
    if owner is None:
        start = np.flatnonzero(change)
        count = np.diff(np.r_[start, n])
    else:
        whole = owner[:n] == owner[length - 1 :]
        change[1:] |= owner[1:n] != owner[: n - 1]
        change[1:] |= whole[1:] != whole[:-1]
        start = np.flatnonzero(change)
        count = np.diff(np.r_[start, n])
        keep = whole[start]
        start, count = start[keep], count[keep]
    anchor = p[start]
    return h[anchor], start, count, anchor - start


def pieces(texts: list[bytes], length: int):
    """Lays documents out in buffers of about PIECE bytes; yields (buffer, owner, owner's number, offset in it)."""
    some, size = [], 0
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        if len(t) > PIECE:
            for at_ in range(0, len(t) - length + 1, PIECE):
                yield np.frombuffer(t[at_ : at_ + PIECE + length - 1], np.uint8), None, np.array([i]), np.array([at_])
            continue
        some.append(i)
        size += len(t)
        if size >= PIECE:
            yield _joined(texts, some)
            some, size = [], 0
    if some:
        yield _joined(texts, some)


def _joined(texts, some):
    sizes = np.array([len(texts[i]) for i in some])
    return np.frombuffer(b"".join(texts[i] for i in some), np.uint8), np.repeat(np.arange(len(some)), sizes), np.array(some), -np.r_[0, np.cumsum(sizes)[:-1]]


def runs_of(texts: list[bytes], length: int):
    """All anchor runs of some documents: (hash, document's index, start in it, count, anchor offset, buffer, start in buffer)."""
    for buf, owner, who, shift in pieces(texts, length):
        h, start, count, off = anchor_runs(buf, owner, length)
        if len(h):
            o = owner[start] if owner is not None else np.zeros(len(start), np.int64)
            yield h, who[o], start + shift[o], count, off, buf, start


def _split(group: np.ndarray):
    """Order by group, and the slice of each group that has entries."""
    order = np.argsort(group, kind="stable")
    g = group[order]
    if not len(g):
        return order, []
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    return order, [(int(g[a]), a, b) for a, b in zip(starts, np.r_[starts[1:], len(g)])]


def _group_of(n_groups: int, h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(n_groups)).astype(np.int32)


def _raw(column) -> list[bytes]:
    return [x if x is not None else b"" for x in column.to_pylist()]


def _data(column) -> bytes:
    """A binary column's values one after the other, without an object for each."""
    out = []
    for c in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(c) and c.buffers()[2] is not None:
            at_ = np.frombuffer(c.buffers()[1], np.int32, len(c) + 1, 4 * c.offset)
            out.append(memoryview(c.buffers()[2])[at_[0] : at_[-1]])
    return b"".join(out)


def _cat(column, kind) -> np.ndarray:
    return np.frombuffer(_data(column), dtype=kind)


def _anchor_hashes(ctx: np.ndarray, at_: np.ndarray) -> np.ndarray:
    """A number for the K bytes at each place; some at a time, as the places of their bytes take several times the contexts."""
    h = np.empty(len(at_), np.uint64)
    for x in range(0, len(at_), SOME):
        anchor = ctx[at_[x : x + SOME, None] + np.arange(K)].view("<u8")
        h[x : x + SOME] = (anchor[:, 0] * np.uint64(0x9E3779B97F4A7C15)) ^ (anchor[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F))
    return h


def one_each(docs: pa.Table) -> pa.Table:
    """A group's distinct texts, each with its least document id, always in the same order."""
    keys = [docs.column(c).to_numpy() for c in ("r1", "r2", "did")]
    order = np.lexsort(keys[::-1])
    r1, r2 = keys[0][order], keys[1][order]
    return docs.take(pa.array(order[np.r_[True, (r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1])]]))


def _several(h: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, and how many documents have each."""
    order = np.lexsort((who, h))
    h, who = h[order], who[order]
    if not len(h):
        return h, np.empty(0, np.int64)
    new = np.r_[True, h[1:] != h[:-1]]
    starts = np.flatnonzero(new)
    return h[starts], np.add.reduceat((new | np.r_[True, who[1:] != who[:-1]]).astype(np.int64), starts)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each x is one of the sorted known ones."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def send_anchors(n_groups: int, length: int):
    """Of a group of documents: its anchors' hashes, by the group of the hash."""

    def run(docs: pa.Table) -> pa.Table:
        home = docs.column("pt")[0].as_py()
        docs = one_each(docs)
        hs, who = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for h, i, *_ in runs_of(_raw(docs.column("text")), length):
            hs.append(h)
            who.append(i)
        h, times = _several(np.concatenate(hs), np.concatenate(who))
        order, groups = _split(_group_of(n_groups, h))
        h, times = h[order], times[order]
        parts = [(h[a:b], times[a:b], times[a:b] > 1) for _, a, b in groups]
        blobs = {"one": [x[~m].tobytes() for x, _, m in parts], "many": [x[m].tobytes() for x, _, m in parts], "times": [t[m].astype("<u4").tobytes() for _, t, m in parts]}
        return pa.table({"pt": pa.array([g for g, _, _ in groups], pa.int32()), "home": pa.array([home] * len(groups), pa.int32()), **{c: pa.array(v, pa.binary()) for c, v in blobs.items()}})

    return run


def shared_anchors(hot_docs: int):
    """Of a group of hashes: those that another group's document has too, sent back to the groups that cannot know,
    and those that more than hot_docs documents have, to all groups that have them."""

    def run(t: pa.Table) -> pa.Table:
        homes = t.column("home").to_numpy()
        one, many = _raw(t.column("one")), _raw(t.column("many"))
        h = np.frombuffer(b"".join(one) + b"".join(many), np.uint64)
        home = np.r_[np.repeat(homes, [len(x) // 8 for x in one]), np.repeat(homes, [len(x) // 8 for x in many])]
        times = np.r_[np.ones(sum(map(len, one)) // 8, np.int64), _cat(t.column("times"), "<u4")]
        _, number = np.unique(h, return_inverse=True)
        total = np.bincount(number, times)[number] if len(h) else times
        hot = total > hot_docs
        keep = hot | ((times == 1) & (total > 1))
        h, home, hot = h[keep], home[keep], hot[keep]
        order, groups = _split(home)
        h, hot = h[order], hot[order]
        return pa.table({"pt": pa.array([g for g, _, _ in groups], pa.int32()), "h": pa.array([h[a:b].tobytes() for _, a, b in groups], pa.binary()), "hot": pa.array([h[a:b][hot[a:b]].tobytes() for _, a, b in groups], pa.binary())})

    return run


def united(who: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intervals of several documents as maximal runs, in the form of MARK."""
    out = np.empty(0, MARK)
    if len(who):
        base = who.astype(np.int64) * SPAN
        a, b = unite(base + a, base + b)
        out = np.empty(len(a), MARK)
        out["who"], out["a"], out["b"] = a // SPAN, a % SPAN, b - a // SPAN * SPAN
    return out


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each size, one after the other."""
    return np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


def _weights(length: int) -> np.ndarray:
    """Odd factors that make a string's bytes a number to deal it by."""
    return np.random.default_rng(length).integers(1, 2**63, length, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def send_contexts(n_groups: int, length: int):
    """Of a group of documents and its shared anchors: the contexts of least id, by the group of the anchor's hash.

    The group's own removals travel with them, to the group of hashes of the group's number.
    """

    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        names = ("pt", "home", *CONTEXTS, "marks")
        out = {c: [] for c in names}
        if docs.num_rows:
            home = docs.column("pt")[0].as_py()
            docs = one_each(docs)
            texts, dids = _raw(docs.column("text")), docs.column("did").to_numpy()
            got = list(runs_of(texts, length))
        if docs.num_rows and got:
            # First the hashes alone, so that contexts are copied only where they are needed.
            h, times = _several(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
            many = h[times > 1]
            wanted = np.union1d(_cat(shared.column("h"), np.uint64) if shared.num_rows else np.empty(0, np.uint64), many)
            kept = []
            for h, i, start, count, off, buf, in_buf in got:
                keep = _among(h, wanted)
                if keep.any():
                    size = count[keep] + length - 1
                    kept.append((h[keep], i[keep], start[keep], count[keep], off[keep], size, buf[_ranges(in_buf[keep], size)]))
            del got
            if kept:
                h, i, start, count, off, size = (np.concatenate([g[k] for g in kept]) for k in range(6))
                ctx = np.concatenate([g[6] for g in kept])
                del kept
                begin = np.cumsum(size) - size
                # Contexts that documents of this group share: only the least id's are sent.
                least: dict[tuple, int] = {}
                own = np.flatnonzero(_among(h, many))
                raw = memoryview(ctx)
                keys = [(bytes(raw[x : x + s]), o) for x, s, o in zip(begin[own].tolist(), size[own].tolist(), off[own].tolist())]
                for k, d in zip(keys, dids[i[own]].tolist()):
                    if d < least.setdefault(k, d):
                        least[k] = d
                low = dids[i].copy()
                low[own] = [least[k] for k in keys]
                del keys, least
                gone = low < dids[i]
                marks = united(i[gone], start[gone], (start + size)[gone])
                sent = ~gone
                h, i, start, count, off, size, begin = (c[sent] for c in (h, i, start, count, off, size, begin))
                pt = _group_of(n_groups, h)
                hot = _among(h, np.sort(_cat(shared.column("hot"), np.uint64))) if shared.num_rows else np.zeros(len(h), bool)
                if hot.any():
                    x = np.flatnonzero(hot)
                    each, m = np.repeat(x, count[x]), count[x].sum()
                    at_ = _ranges(np.zeros(len(x), np.int64), count[x])  # each string's place in its context
                    string = np.ascontiguousarray(ctx[(begin[each] + at_)[:, None] + np.arange(length)])
                    _, same = np.unique(np.c_[string, (off[each] - at_).astype("<u2").view(np.uint8).reshape(-1, 2)].view(f"V{length + 2}").ravel(), return_inverse=True)
                    low = np.full(m, np.iinfo(np.int64).max)
                    np.minimum.at(low, same, dids[i[each]])
                    gone = low[same] < dids[i[each]]
                    first = (start[each] + at_)[gone]
                    marks = np.r_[marks, united(i[each][gone], first, first + length)]
                    each, at_, string = each[~gone], at_[~gone], string[~gone]
                    pt = np.r_[pt[~hot], _group_of(n_groups, string.astype(np.uint64) @ _weights(length))]
                    h, i, start, begin, off = (np.r_[c[~hot], c[each] + d] for c, d in ((h, np.uint64(0)), (i, 0), (start, at_), (begin, at_), (off, -at_)))
                    count, size = np.r_[count[~hot], np.ones(len(each), np.int64)], np.r_[size[~hot], np.full(len(each), length)]
                order, groups = _split(pt)
                for g, a, b in groups:
                    o = order[a:b]
                    for c, v in zip(CONTEXTS, (i[o].astype("<u4"), dids[i[o]], start[o].astype("<u4"), count[o].astype("<u2"), off[o].astype("<u2"), ctx[_ranges(begin[o], size[o])])):
                        out[c].append(v.tobytes())
                    out["pt"].append(g)
                    out["home"].append(home)
                    out["marks"].append(None)
                if len(marks):
                    out["pt"].append(home)
                    out["home"].append(home)
                    out["marks"].append(marks.tobytes())
                    for c in CONTEXTS:
                        out[c].append(None)
                del ctx, texts, begin, size
        return pa.table({c: pa.array(out.pop(c), pa.int32() if c in ("pt", "home") else pa.binary()) for c in names})

    return run


def _earliest(ctxs: list[bytes], offs: np.ndarray, counts: np.ndarray, dids: np.ndarray, length: int) -> np.ndarray:
    """For each string of each context: the least document id of all contexts that hold it."""
    sizes = np.array([len(c) for c in ctxs], dtype=np.int64)
    # Anchors are put at multiples of V, so strings that can be equal have equal residues.
    lead = (-offs) % V
    room = lead + sizes
    room += (-room) % V
    begin = np.r_[0, np.cumsum(room)[:-1]] + lead
    text = np.zeros(int(room.sum()), dtype=np.uint8)
    flat = np.frombuffer(b"".join(ctxs), np.uint8)
    text[np.repeat(begin - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(len(flat))] = flat
    first = np.r_[0, np.cumsum(counts)[:-1]]
    where = np.repeat(begin - first, counts) + np.arange(counts.sum())
    number = np.empty(len(text), dtype=np.int64)
    number[where] = np.arange(len(where))
    owner = np.repeat(dids, counts)
    w = words(text)
    out = np.empty(len(where), dtype=np.int64)
    for bucket in sort_suffixes(text, where):
        new = np.zeros(len(bucket), dtype=bool)
        for k in [*range(0, length - 7, 8), length - 8]:
            x = at(w, bucket + k)
            new[1:] |= x[1:] != x[:-1]
        new[0] = True  # a bucket is a range of the first eight bytes: equal strings share it
        i = number[bucket]
        starts = np.flatnonzero(new)
        low = np.minimum.reduceat(owner[i], starts)
        out[i] = low[np.cumsum(new) - 1]
    return out


def find_repeats(length: int):
    """Of a group of contexts: the intervals to remove, sent to the groups of their documents."""

    def run(t: pa.Table) -> pa.Table:
        homes, passed = t.column("home").to_numpy(), t.column("marks").to_pylist()
        out = {"pt": [int(h) for h, m in zip(homes, passed) if m is not None], "marks": [m for m in passed if m is not None]}
        home = np.repeat(homes, pc.binary_length(t.column("who")).fill_null(0).to_numpy() // 4)
        who, did, start = _cat(t.column("who"), "<u4"), _cat(t.column("did"), np.int64), _cat(t.column("start"), "<u4").astype(np.int64)
        n, off = _cat(t.column("n"), "<u2").astype(np.int64), _cat(t.column("off"), "<u2").astype(np.int64)
        ctx = _data(t.column("ctx"))
        del t
        size = n + length - 1
        end = np.cumsum(size)
        begin = end - size
        got = [(np.empty(0, np.int64),) * 3]
        if len(n):
            # The anchor itself tells which contexts belong together; its hash need not be sent.
            h = _anchor_hashes(np.frombuffer(ctx, np.uint8), begin + off)
            # Anchors' hashes in ranges that fit the sort: equal strings have equal anchors.
            order = np.argsort(h, kind="stable")
            cum = np.cumsum(size[order])
            edge = np.r_[True, h[order][1:] != h[order][:-1]]
            part = np.maximum.accumulate(np.where(edge, cum // SORT_BYTES, 0))
            s = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
            del h, cum, edge, part
            for lo, hi in zip(s[:-1], s[1:]):
                got.append(_marked(order[lo:hi], ctx, begin, end, off, did, start, length))
        row, a, b = (np.concatenate(x) for x in zip(*got))
        order, groups = _split(home[row.astype(np.int64)] if len(row) else np.empty(0, np.int32))
        row, a, b = row[order], a[order], b[order]
        for g, x, y in groups:
            out["pt"].append(g)
            out["marks"].append(united(who[row[x:y]], a[x:y], b[x:y]).tobytes())
        return pa.table({"pt": pa.array(out["pt"], pa.int32()), "marks": pa.array(out["marks"], pa.binary())})

    return run


def _marked(mine, ctx, begin, end, off, did, start, length):
    """Of the contexts `mine`: (context, first, last + 1 byte of its document) of each run of strings that an earlier document holds."""
    seen: dict[tuple, int] = {}
    which = np.empty(len(mine), dtype=np.int64)
    for j, (a, b, o) in enumerate(zip(begin[mine].tolist(), end[mine].tolist(), off[mine].tolist())):
        which[j] = seen.setdefault((ctx[a:b], o), len(seen))
    low = np.full(len(seen), np.iinfo(np.int64).max)
    np.minimum.at(low, which, did[mine])
    ctxs, offs = [k[0] for k in seen], np.array([k[1] for k in seen], dtype=np.int64)
    counts = np.array([len(c) for c in ctxs], dtype=np.int64) - length + 1
    least = _earliest(ctxs, offs, counts, low, length)
    first = np.cumsum(counts) - counts
    # A document of greater id than its context's least one loses all of it.
    whole = did[mine] > low[which]
    got = [(mine[whole], start[mine][whole], start[mine][whole] + counts[which[whole]] - 1 + length)]
    mine, which = mine[~whole], which[~whole]
    m = counts[which]
    base = np.cumsum(m) - m
    marked = least[_ranges(first[which], m)] < np.repeat(did[mine], m) if len(m) else np.empty(0, bool)
    owner = np.repeat(np.arange(len(mine)), m)
    same = owner[1:] == owner[:-1]
    on = np.flatnonzero(marked & ~np.r_[False, marked[:-1] & same])
    to = np.flatnonzero(marked & ~np.r_[marked[1:] & same, False]) if len(marked) else on
    w = owner[on]
    got.append((mine[w], start[mine][w] + on - base[w], start[mine][w] + to - base[w] + length))
    return tuple(np.concatenate(x) for x in zip(*got))


def unite(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as maximal runs."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.r_[True, a[1:] > b[:-1]]
    starts = np.flatnonzero(new)
    return a[starts], b[np.r_[starts[1:], len(b)] - 1]


def cut_out(with_text: bool):
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        cuts = _cat(marks.column("marks"), MARK) if marks.num_rows else np.empty(0, MARK)
        cuts = cuts[np.argsort(cuts["who"], kind="stable")]
        a, b = cuts["a"].astype(np.int64), cuts["b"].astype(np.int64)
        docs = one_each(docs) if docs.num_rows else docs
        lo, hi = (np.searchsorted(cuts["who"], np.arange(docs.num_rows, dtype=np.uint32), side=s) for s in ("left", "right"))
        removed, spans, sha, kept = [], [], [], []
        for i, t in enumerate(_raw(docs.column("text"))):
            if hi[i] > lo[i]:
                x, y = unite(a[lo[i] : hi[i]], b[lo[i] : hi[i]])
                out = b"".join(t[p:q] for p, q in zip(np.r_[0, y].tolist(), np.r_[x, len(t)].tolist()))
                removed.append(int((y - x).sum()))
                spans.append(len(x))
            else:
                out = t
                removed.append(0)
                spans.append(0)
            sha.append(hashlib.sha256(out).hexdigest())
            if with_text:
                kept.append(out.decode("utf-8", errors="ignore"))
        cols = {"r1": docs.column("r1"), "r2": docs.column("r2"), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        if with_text:
            cols["kept_text"] = pa.array(kept, pa.string())
        return pa.table(cols)

    return run


def local_heads(batches):
    """Of equal texts that one task sees, lets the first pass, and later ones only with a smaller id."""
    seen: dict[tuple[int, int], int] = {}
    for batch in batches:
        keep = []
        for k, d in zip(zip(batch.column("r1").to_pylist(), batch.column("r2").to_pylist()), batch.column("did").to_pylist()):
            keep.append(k not in seen or d < seen[k])
            if keep[-1]:
                seen[k] = d
        yield batch.filter(pa.array(keep, pa.bool_()))


def _keys(text):
    """The size of a text, and the two hashes that with it name a distinct text."""
    size = F.octet_length(text).cast("long")
    return size, F.xxhash64(text, size), F.xxhash64(F.lit(7), text)


def _repeats(docs: DataFrame, length: int, with_text: bool, hot_docs: int) -> tuple[DataFrame, DataFrame]:
    """(r1, r2, first_did) and (r1, r2, n_removed, n_spans, kept_sha256[, kept_text]), one row for each distinct text."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = partitions_for(total, int(GROUP_BYTES * max(1.0, total / GROW_BYTES) ** 0.25), 8)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), text.alias("text"))
    _, r1, r2 = _keys(F.col("text"))
    rows = rows.select("did", "text", r1.alias("r1"), r2.alias("r2"))
    first = rows.groupBy("r1", "r2").agg(F.min("did").alias("first_did"))
    group = F.pmod(F.shiftrightunsigned("r1", 20), F.lit(n)).cast("int")
    # Copies are merged in each task before they meet; the groups' functions merge what is left.
    distinct = rows.mapInArrow(over_batches(local_heads), "did long, text binary, r1 long, r2 long").withColumn("pt", group).repartition(n, "pt")
    # All three readers take the same columns, so the texts are shuffled once and the exchange is reused.
    blobs = distinct.groupBy("pt").applyInArrow(over_groups(send_anchors(n, length)), HASHES)
    shared = blobs.groupBy("pt").applyInArrow(over_groups(shared_anchors(hot_docs)), "pt int, h binary, hot binary")
    contexts = distinct.groupBy("pt").cogroup(shared.groupBy("pt")).applyInArrow(over_groups(send_contexts(n, length)), BLOB)
    marks = contexts.groupBy("pt").applyInArrow(over_groups(find_repeats(length)), MARKS)
    schema = "r1 long, r2 long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return first, distinct.groupBy("pt").cogroup(marks.groupBy("pt")).applyInArrow(over_groups(cut_out(with_text)), schema)


def dedup(docs: DataFrame, length: int = LENGTH, hot_docs: int = HOT_DOCS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    return _resolved(docs, length, False, hot_docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def clean(docs: DataFrame, length: int = LENGTH, hot_docs: int = HOT_DOCS) -> DataFrame:
    """docs with the repeated bytes cut from text, and n_chars brought up to date.

    The remains of a character that was cut through are dropped.  A document that loses
    every byte is a copy of earlier ones and goes; an empty or null text stays as it is.
    """
    out = _resolved(docs, length, True, hot_docs).where("n_bytes = 0 or n_removed < n_bytes")
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.when(F.col("n_bytes") > 0, F.col("kept_text")).otherwise(F.when(F.col("__null"), F.lit(None)).otherwise(F.lit(""))).alias("text"))
        elif c == "n_chars":
            columns.append(F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("__docs.n_chars")).alias("n_chars"))
        else:
            columns.append(F.col(f"__docs.`{c}`").alias(c))
    return out.select(*columns)


def _resolved(docs: DataFrame, length: int, with_text: bool, hot_docs: int) -> DataFrame:
    if length < K + 8:
        raise ValueError(f"length must be at least {K + 8} bytes")
    first, result = _repeats(docs, length, with_text, hot_docs)
    size, r1, r2 = _keys(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    own = docs.select("*", size.alias("n_bytes"), r1.alias("__r1"), r2.alias("__r2"), F.col("text").isNull().alias("__null")).drop("text").alias("__docs")
    for right, how in ((first, "inner"), (result, "left")):
        right = right.withColumnsRenamed({"r1": "__q1", "r2": "__q2"})
        own = own.join(right, (F.col("__r1") == F.col("__q1")) & (F.col("__r2") == F.col("__q2")), how).drop("__q1", "__q2")
    copy = (F.coalesce(F.col("__docs.doc_id").cast("long"), F.lit(NULL_ID)) > F.col("first_did")) & (F.col("__docs.n_bytes") >= length)
    own = own.withColumn("n_spans", F.when(copy, F.lit(1)).otherwise(F.col("n_spans")).cast("long"))
    own = own.withColumn("kept_sha256", F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")))
    return own.withColumn("n_removed", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")))


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


SQL = {
    "op9_suffix_dedup": """with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, '')))::bigint as n from documents),
strings as (select doc_id, p, substr(h, 2 * p + 1, 100) as s from (select doc_id, h, unnest(range(0, n - 49)) as p from d where n >= 50)),
low as (select s, min(doc_id) as m from strings group by s),
hit as (select doc_id, p from strings join low using (s) where m < doc_id),
step as (select doc_id, p, coalesce((p > lag(p) over (partition by doc_id order by p) + 50)::int, 1) as new from hit),
runs as (select doc_id, p, sum(new) over (partition by doc_id order by p) as g from step),
spans as (select doc_id, min(p) as a, max(p) + 50 as b from runs group by doc_id, g),
sums as (select doc_id, sum(b - a)::bigint as n_removed, count(*) as n_spans, max(b) as last from spans group by doc_id),
parts as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as x, a as y from spans union all select doc_id, last, n from sums join d using (doc_id)),
kept as (select doc_id, string_agg(substr(h, (2 * x + 1)::bigint, (2 * (y - x))::bigint), '' order by x) as k from parts join d using (doc_id) group by doc_id)
select doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(k, h))) as kept_sha256 from d left join sums using (doc_id) left join kept using (doc_id)""",
}

QUERIES = {"op9_suffix_dedup": op9_suffix_dedup}
