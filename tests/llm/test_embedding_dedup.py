import numpy as np

from litloom.llm import embedding_dedup as M


def brute(rows, threshold=0.9):
    ok = [i for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for p, i in enumerate(ok):
        for j in ok[:p]:
            if len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, links[i], min(ids) if ids else None, d == (min(ids) if ids else None)))
    return sorted(out, key=str)


def vectors():
    r = np.random.default_rng(3)
    rows, d = [], 0
    for size in [1] * 60 + [2] * 20 + [5] * 6 + [70]:
        base = r.standard_normal(16)
        for _ in range(size):
            noise = r.standard_normal(16)
            rows.append((d, (base + r.uniform(0, 0.15) * noise).astype(np.float32).tolist()))
            d += 1
    same = rows[3][1]
    rows += [(500 + i, same) for i in range(9)] + [(600, None), (601, []), (602, [0.0] * 16), (603, [1.0, None] + [0.0] * 14), (604, [float("nan")] + [1.0] * 15), (605, [float("inf")] + [1.0] * 15), (606, [1.0, 2.0]), (607, [1.0, 2.1]), (None, same), (None, [5.0] + [0.0] * 15), (3, same)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, v, 1, "x") for d, v in rows], "vec_id long, embedding array<float>, node int, key string").repartition(3)


def test_against_brute_force(spark, monkeypatch):
    rows = vectors()
    rows = [(d, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for d, v in rows]
    monkeypatch.setattr(M, "RECALL", 0.999999)
    want = brute(rows)
    assert sorted(map(tuple, M.near_duplicates(frame(spark, rows)).collect()), key=str) == want
    monkeypatch.setattr(M, "BLOCK", 6)
    monkeypatch.setattr(M, "SMALL", 4)
    monkeypatch.setattr(M, "GROUP_ROWS", 500)
    assert sorted(map(tuple, M.near_duplicates(frame(spark, rows)).collect()), key=str) == want


def test_empty(spark):
    assert M.near_duplicates(frame(spark, vectors()).limit(0)).count() == 0


def test_recall_at_the_threshold():
    r = np.random.default_rng(8)
    a = r.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    u = r.standard_normal((2000, 64))
    u -= (u * a).sum(1, keepdims=True) * a
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    b = 0.9 * a + np.sqrt(1 - 0.81) * u
    places, tables = M.plan(50_000, 0.9)
    hit = (M.codes(a, places, tables) == M.codes(b, places, tables)).any(axis=1).mean()
    assert hit > 0.94


def test_groups_of_one_large_bucket_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 10)
    monkeypatch.setattr(M, "GROUP_ROWS", 20)
    entries = spark.range(200).selectExpr("id as node", "1L as key")
    heavy = spark.createDataFrame([(1, 200)], "key long, n long")
    sizes = [r[0] for r in M._dealt(entries, heavy, 200).groupBy("g").count().select("count").collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 200


def test_huge_and_tiny_components(spark):
    """Squares that over- or underflow do not matter; nor does a very long vector."""
    rows = [(1, [1e200, 1e199]), (2, [1.0, 0.1]), (3, [1e-200, 1e-201]), (4, [1.0, -1.0]), (5, [1e300, -1e300]), (6, [1.0] * 20_000), (7, [1.0] * 19_999 + [0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, M.near_duplicates(d).collect()))
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 6, False)]


def test_sketches_keep_pairs_at_the_threshold():
    r = np.random.default_rng(4)
    a = r.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    u = r.standard_normal((4000, 64))
    u -= (u * a).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(0.19) * u / np.linalg.norm(u, axis=1, keepdims=True)
    apart = lambda x, y: np.bitwise_count(M.sketches(x) ^ M.sketches(y)).sum(axis=1)
    assert (apart(a, b) <= M.most_apart(0.9)).all() and (apart(a, u) > M.most_apart(0.9)).all()


def test_query_over_the_whole_table(spark):
    """The registered query's links against all cosines: recall and no false link."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()
    want = {d: n for d, n, _, _ in brute([(r.vec_id, r.embedding) for r in rows])}
    got = {r.vec_id: r.n_links for r in M.op3_pstable_embedding_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert got.keys() == want.keys() and all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.97 * sum(want.values())
