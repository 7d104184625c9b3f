import random

import numpy as np

from litloom.llm import mixing as M


def test_targets():
    assert M.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    t = M.targets([1000, 10, 10], [1, 2, 3])
    assert t[1:] == [30, 30] and abs(sum(t) - 1020) < 1e-9
    assert M.targets([0, 5], [1, 2]) == [0, 5] and M.targets([], []) == []


def test_pivotal_keeps_the_sum_and_expectation():
    size = np.array([5.0, 3, 9, 1, 4, 7, 2, 8] * 10 + [150])
    size = np.sort(size)[::-1]
    p = np.full(len(size), 0.3)
    total = np.zeros(len(size))
    for seed in range(4000):
        x = M.pivotal(p, size, np.random.default_rng(seed))
        frac = (x > 0) & (x < 1)
        assert abs((x * size).sum() - (p * size).sum()) < 1e-6
        assert size[frac].sum() <= 20  # the last and smallest ones
        total += x
    assert abs(total / 4000 - 0.3).max() < 0.05


def test_one_large_document_is_not_what_is_left():
    size = np.array([20_020.0] + [400.0] * 500)
    missed = [abs(M.pivotal(np.full(501, 0.456), size, np.random.default_rng(s)).round() @ size - 0.456 * size.sum()) for s in range(100)]
    assert max(missed) <= 400


def test_no_document_takes_all_words_of_small_fractions():
    """A source near a multiple of its size: fractions of fewer words than its large documents have."""
    size = np.array([6005.0, 4278, 3213, 2742, 1900] + [float(k) for k in range(800, 0, -2)])
    for p in (0.009, 0.991):
        for seed in range(300):
            x = M.pivotal(np.full(len(size), p), size, np.random.default_rng(seed))
            left = (x > 0) & (x < 1)
            assert abs((x * size).sum() - p * size.sum()) < 1e-3 and size[left].sum() <= 400, (p, seed, size[left])


def docs(spark, n=900):
    r = random.Random(1)
    rows = [(i, " ".join("w" * 3 for _ in range(r.randint(0, 40))), r.choice(["a", "a", "a", "a", "b", "é", "\U0001f600", None])) for i in range(n)]
    rows += [(None, "x y", "a"), (5, "p q r", "b"), (5, "p q r", "b"), (6, None, "b"), (7, " x y", "lone")]
    return spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, source string, size int")


def test_mix(spark):
    d = docs(spark)
    for fan in (20_000, 50, 5):
        got = M.mix(d, fan=fan).collect()
        again = M.mix(d.repartition(7), fan=fan).collect()
        assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == d.count()
        sources = {}
        for r in got:
            assert 0 <= r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
            x = sources.setdefault((r.source_size, r.target), [0, 0, 0])
            x[0] += r["size"]
            x[1] += r.taken
            x[2] = max(x[2], r["size"])
        for (size, target), (s, taken, most) in sources.items():
            assert s == size and abs(taken - target) <= most, (size, target, taken)
        assert abs(sum(t for _, t in sources) - sum(s for s, _ in sources)) < 1e-6


def test_take_and_empty(spark):
    d = docs(spark)
    taken = M.take_mix(d)
    assert taken.columns == d.columns
    assert taken.groupBy().agg({"doc_id": "count"}).first()[0] > 0
    assert M.mix(d.limit(0)).count() == 0 and M.take_mix(d.limit(0)).count() == 0


def test_query_over_the_whole_table(spark):
    """Sums, bounds and reruns of the registered query, against plain Python over the same rows."""
    import re

    folder = "/root/testdata/sf0.1"
    own = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = M.op4_pivotal_mix(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(own) and sorted(got) == sorted(M.op4_pivotal_mix(spark, folder).collect())
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in own.items()}
    order = sorted({r.source for r in own.values()}, key=lambda s: (s is None, s or ""))
    sums = [sum(words[i] for i, r in own.items() if r.source == s) for s in order]
    want = M.targets(sums, [1 + k % 3 for k in range(len(order))])
    taken = dict.fromkeys(order, 0)
    for r in got:
        k = order.index(own[r.doc_id].source)
        assert r["size"] == words[r.doc_id] and r.source_size == sums[k] and abs(r.target - want[k]) < 1e-6 and 0 <= r.taken <= 3 * r["size"]
        taken[own[r.doc_id].source] += r.taken
    for s, target in zip(order, want):
        assert abs(taken[s] - target) <= 0.005 * target, (s, target, taken[s])


def test_very_long_text_and_ties(spark):
    rows = [(i, "w " * 200, "a") for i in range(200)] + [(900, "long " * 1_000_000, "a"), (901, "x", "b")]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken = sum(r.taken for r in got if r.source_size > 1)
    target = next(r.target for r in got if r.source_size > 1)
    assert len(got) == 202 and taken % 200 == 0 and 0 < target
