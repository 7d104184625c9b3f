import hashlib
import random

import numpy as np
import pytest

from litloom.llm import suffix_dedup as S
from litloom.llm.suffix_array import COVER, V, difference_cover, sort_suffixes


def brute(rows, length=50):
    """rows: (doc_id, text); every string by a dictionary of its least document id."""
    key = [-(2**63) if d is None else d for d, _ in rows]
    texts = [(t or "").encode() for _, t in rows]
    low = {}
    for d, t in zip(key, texts):
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            low[s] = min(low.get(s, d), d)
    out = []
    for (doc_id, _), d, t in zip(rows, key, texts):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if low[t[i : i + length]] < d:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((doc_id, len(t), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    shared = [" ".join(word() for _ in range(30)) for _ in range(6)]
    rows = []
    for d in range(60):
        parts = [" ".join(word() for _ in range(r.randint(0, 60)))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randint(0, 30)
            parts.insert(r.randint(0, len(parts)), s[a : a + r.randint(30, len(s))])
        rows.append((d, r.choice([" ", "", "\n"]).join(parts)))
    rows += [(60, None), (61, ""), (62, "x" * 49), (63, "x" * 50), (64, "x" * 400), (65, "y" * 300), (65, "y" * 300), (66, "y" * 300), (None, rows[4][1]), (5, rows[7][1]), (7, rows[7][1])]
    rows += [(70, rows[10][1] * 40), (71, "ab" * 200), (72, "ba" * 150), (73, rows[10][1] * 37 + "z")]
    return rows


def test_difference_cover():
    assert {(a - b) % V for a in COVER for b in COVER} == set(range(V))
    assert len(difference_cover(13)) <= 5


@pytest.mark.parametrize("text", ["banana" * 40, "a" * 300, "mississippi" * 30 + "x" + "mississippi" * 30, "".join(random.Random(1).choice("ab") for _ in range(900)), "b", ""])
@pytest.mark.parametrize("bucket", [7, 1 << 20])
def test_sort_suffixes(text, bucket):
    t = text.encode()
    got = [int(x) for b in sort_suffixes(np.frombuffer(t, np.uint8), bucket=bucket) for x in b]
    assert got == sorted(range(len(t)), key=lambda i: t[i:])


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s") for d, t in rows], "doc_id long, text string, rid string, did string").repartition(5)


def test_against_brute_force(spark, monkeypatch):
    rows = corpus()
    got = sorted(map(tuple, S.dedup(frame(spark, rows)).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    monkeypatch.setattr(S, "GROUP_BYTES", 1000)
    monkeypatch.setattr(S, "SORT_BYTES", 3000)
    monkeypatch.setattr(S, "PIECE", 700)
    got = sorted(map(tuple, S.dedup(frame(spark, rows)).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_clean_and_empty(spark):
    rows = [(1, "k" * 60), (2, "k" * 60), (3, None), (4, ""), (5, "é" * 10 + "k" * 60 + "tail")]
    got = {r.doc_id: (r.text, r.rid) for r in S.clean(frame(spark, rows)).collect()}
    assert got == {1: ("k" * 60, "en"), 3: (None, "en"), 4: ("", "en"), 5: ("é" * 10 + "tail", "en")}
    none = frame(spark, rows).limit(0)
    assert S.dedup(none).count() == 0 and S.clean(none).columns == none.columns


def test_a_passage_in_every_document_is_spread(spark):
    """A group sends its inner contexts once; those at its ends, which go on into own texts, are dealt by string."""
    import pyarrow as pa

    r = random.Random(4)
    passage = "".join(r.choice("abcdefgh ") for _ in range(280)).encode()

    def sent(n, hot):
        texts = [("%08d" % i).encode() * 3 + passage + ("%09d" % (i * 7919)).encode() * 3 for i in range(n)]
        docs = pa.table({"did": pa.array(range(n), pa.int64()), "text": pa.array(texts, pa.binary()), "r1": pa.array(range(n), pa.int64()), "r2": pa.array([0] * n, pa.int64()), "pt": pa.array([3] * n, pa.int32())})
        hashes = S.send_anchors(97, 50)(docs)
        back = [S.shared_anchors(hot)(hashes.slice(i, 1)) for i in range(hashes.num_rows)]
        t = S.send_contexts(97, 50)(docs, pa.concat_tables(back))
        marks = np.frombuffer(b"".join(m for m in t.column("marks").to_pylist() if m), S.MARK)
        assert len(set(marks["who"].tolist())) == n - 1
        groups = {}
        for g, c in zip(t.column("pt").to_pylist(), t.column("ctx").to_pylist()):
            groups[g] = groups.get(g, 0) + len(c or b"")
        return max(groups.values()), sum(groups.values())

    largest, total = sent(2000, 10**9)
    assert largest < 2000 * 200  # the ends only
    largest, total = sent(2000, 1000)
    assert largest < total / 40


@pytest.mark.parametrize("hot", [2, 20, 0])
def test_query_against_brute_force(spark, tmp_path, hot):
    """The registered query's operator on a table with a passage in every document."""
    r = random.Random(8)
    passage = " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(60))
    rows = corpus(11) + [(1000 + i, f"{i} own {i * 31} words {passage} end {i * 17}") for i in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    out = S.op9_suffix_dedup(spark, str(tmp_path)) if hot == 0 else S.dedup(spark.read.parquet(str(tmp_path / "documents.parquet")), hot_docs=hot)
    got = [tuple(x) for x in out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))


def test_a_large_group_of_contexts_is_read_in_little_memory():
    """Beside the contexts themselves, what is sorted at once bounds the memory; repeats are found all the same."""
    import tracemalloc

    import pyarrow as pa

    r, k = np.random.default_rng(3), 2000
    kinds, rows = r.integers(97, 123, (8000, 80), dtype=np.uint8), {c: [] for c in (*S.CONTEXTS, "picked")}
    for home in range(40):
        picked = r.integers(0, len(kinds), k)
        ctx = kinds[picked]
        ctx[:, 70:] = r.integers(97, 123, (k, 10))  # the strings before it are those of the kind
        for c, v in (("who", np.arange(k, dtype="<u4")), ("did", home * k + np.arange(k)), ("start", np.zeros(k, "<u4")), ("n", np.full(k, 31, "<u2")), ("off", np.full(k, 20, "<u2")), ("ctx", ctx)):
            rows[c].append(v.tobytes())
        rows["picked"].append(picked)
    picked, homes = np.concatenate(rows.pop("picked")), pa.array(range(40), pa.int32())
    t = pa.table({"pt": homes, "home": homes, **{c: pa.array(v, pa.binary()) for c, v in rows.items()}, "marks": pa.nulls(40, pa.binary())})
    tracemalloc.start()
    out = S.find_repeats(50)(t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    first = set(np.unique(picked, return_index=True)[1].tolist())
    got = {(h, int(w)) for h, m in zip(out.column("pt").to_pylist(), out.column("marks").to_pylist()) for w in np.frombuffer(m, S.MARK)["who"]}
    assert got == {(i // k, i % k) for i in range(40 * k) if i not in first}
    assert peak < 90e6, peak
