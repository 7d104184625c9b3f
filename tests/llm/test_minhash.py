import random

import numpy as np

from litloom.llm import minhash as M
from litloom.llm.common import components


def brute(rows, k=5, percent=80):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((d, len(sets[i]), c, d == c))
    return out


def corpus(n=40, seed=5):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, d = [], 0
    for _ in range(n):
        base = [r.choice(vocab) for _ in range(r.randint(20, 150))]
        for _ in range(r.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 60))):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((d, " ".join(w) if r.random() < 0.8 else "\n".join(w).upper()))
            d += 1
    r.shuffle(rows)
    return rows + [(900, None), (901, ""), (902, " \t"), (903, "one two"), (904, "One  two"), (905, "one two three"), (None, rows[0][1]), (None, "just null"), (906, rows[3][1]), (906, rows[3][1]), (907, rows[5][1]), (907, "another text entirely")]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, node int, kept int").repartition(4)


def test_against_brute_force(spark, monkeypatch):
    rows = corpus()
    want = sorted(brute(rows), key=str)
    assert sorted(map(tuple, M.near_duplicates(frame(spark, rows)).collect()), key=str) == want
    monkeypatch.setattr(M, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(M, "GROUP_BYTES", 4000)
    assert sorted(map(tuple, M.near_duplicates(frame(spark, rows)).collect()), key=str) == want
    kept = M.drop_near_duplicates(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "node", "kept"]
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(set(ids) - {None}) == sorted({d for d, _, _, k in want if k and d is not None})
    assert ids.count(906) <= 1 and ids.count(907) == 1


def test_empty(spark):
    none = frame(spark, [(1, "x")]).limit(0)
    assert M.near_duplicates(none).count() == 0


def test_keys_find_every_pair_within_radius():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**16, (200, M.SYMBOLS), dtype=np.uint16)
    b = a.copy()
    for row in b:
        row[r.choice(M.SYMBOLS, M.RADIUS, replace=False)] ^= np.uint16(1)
    assert (M.chunk_keys(a) == M.chunk_keys(b)).any(axis=1).all()


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 90)] + [(r.randint(100, 300), r.randint(100, 300)) for _ in range(120)] + [(7, 7)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in list(root)}


def near_copies(n=160, seed=3):
    """One family: a chain of texts whose ends differ, and many near copies of one text."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(900)]
    base = [r.choice(vocab) for _ in range(120)]
    rows, w = [], list(base)
    for d in range(n):
        if d % 4 == 0:
            w = list(w)
            w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((d, " ".join(w)))
        else:
            x = list(base)
            x[r.randrange(len(x))] = r.choice(vocab)
            rows.append((d, " ".join(x)))
    r.shuffle(rows)
    return rows


def test_a_large_family_in_many_blocks(spark, monkeypatch):
    rows = near_copies()
    want = sorted(brute(rows), key=str)
    monkeypatch.setattr(M, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(M, "GROUP_BYTES", 8000)
    monkeypatch.setattr(M, "BUCKET", 7)
    monkeypatch.setattr(M, "GROUP_ROWS", 100)
    assert sorted(map(tuple, M.near_duplicates(frame(spark, rows)).collect()), key=str) == want


def test_near_copies_are_not_dealt_to_every_block(spark, monkeypatch):
    """Members connected with their family's least one stay at home: what is dealt does not grow with the blocks."""
    monkeypatch.setattr(M, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(M, "GROUP_BYTES", 2000)
    members = M._blocks(spark.range(200).selectExpr("id as node", "1L as family", "100L as size", "5L as n_shingles", "cast('' as binary) as sig", "cast('' as binary) as text"))
    home = M._at_home(members)
    assert home.count() == 219  # 20 blocks, the least member in each
    assert home.groupBy("g").count().agg({"count": "max"}).first()[0] <= 80
    links = spark.range(1, 195).selectExpr("0L as a", "id as b")
    visits = M._visits(members, links)
    guests = visits.where("mine < 0")
    assert guests.select("node").distinct().count() == 5 and guests.count() == 5 * 19
    assert M._visits(members, spark.range(1, 200).selectExpr("0L as a", "id as b")) is None


def test_very_long_text_and_query(spark, tmp_path):
    r = random.Random(6)
    long = [f"w{r.randrange(10**6)}" for _ in range(200_000)]
    rows = corpus(15, 9) + [(2000, " ".join(long)), (2001, " ".join(long[:-5] + ["x"]))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, M.op8_minhash_hamming(spark, str(tmp_path)).collect()), key=str) == sorted(brute(rows, 4), key=str)


def test_hubs_of_components(spark, monkeypatch):
    from litloom.operators import graph

    monkeypatch.setattr(graph, "LEAST_DEGREE", 5)
    edges = [(0, i) for i in range(1, 300)] + [(i, 1000 + i) for i in range(0, 300, 3)] + [(5000, 5001), (5001, 5002), (5000, 5000)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(300)}, **{1000 + i: 0 for i in range(0, 300, 3)}, 5000: 5000, 5001: 5000, 5002: 5000}
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
