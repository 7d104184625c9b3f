import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from litloom.llm import fingerprints as M

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def parts(text, pattern):
    return [x for x in re.sub(f"({pattern})", "\\1\x01", text).split("\x01") if x]


def brute(text):
    t = [[[sha(x) for x in parts(p, r"[.!?][ \t\n]")] for p in parts(s, r"\n")] for s in parts(text, r"\n[ \t]*\n")]
    ph = lambda p: sha("p" + "".join(p))
    s_hash = lambda s: sha("s" + "".join(map(ph, s)))
    root = sha("r" + str(len(text)) + "".join(map(s_hash, t)) + sha(text))
    out = "|".join([root, *(s_hash(s)[:16] + ":" + ",".join(ph(p)[:16] + "=" + ".".join(x[:12] for x in p) for p in s) for s in t)])
    return out, {x[:12] for s in t for p in s for x in p}


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


ROWS = [(1, "One. Two! Three?\nFour. é中.\n\n\nNew section. End"), (2, None), (3, "x"), (9, "One. Two! Three?\nFour. é中.\n\n\nNew section. End"), (5, "a\x01b. c" * 50), (6, "long words " * 5000), (None, "null id. goes first"), (7, ""), (20, " \n \n\t\n.")]


def test_against_brute_force(spark, monkeypatch):
    docs = spark.createDataFrame([(d, t, "x") for d, t in ROWS], "doc_id long, text string, fingerprint string").repartition(3)
    order = sorted(((-(2**63) if d is None else d), t or "", d) for d, t in ROWS)
    want = {}
    for i, (_, t, d) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        (f, l), (ef, el), (_, nl) = brute(t), brute(edited), brute(nxt)
        want[d] = (len(t), sha(edited), f, ef, like(l, el), like(l, nl))
    for each in (M.RANGE_BYTES, 4000, 100):
        monkeypatch.setattr(M, "RANGE_BYTES", each)
        got = {r.doc_id: tuple(r)[1:] for r in M.compare_with_edits(docs).collect()}
        assert got == want


def test_repeated_ids_and_empty(spark):
    docs = spark.createDataFrame([(1, "a. b"), (1, "a. b"), (1, "c"), (2, "d")], "doc_id long, text string")
    got = M.compare_with_edits(docs).collect()
    assert len(got) == 4 and len({r.fingerprint for r in got}) == 3
    assert M.compare_with_edits(docs.limit(0)).count() == 0
    one = M.compare_with_edits(docs.where("doc_id = 2")).first()
    assert one.near_next == 1.0 and one.n_chars == 1


def test_edited_branches(spark):
    a, b = "One. Two.\nThree.\n\nFour.\nFive.", "One. Two.\nThree.\n\nFour.\nSix."
    row = spark.createDataFrame([(a, b)], "a string, b string")
    f = lambda c: M.encoded(F.col(c), M.tree(F.col(c)))
    got = row.select(M.edited_branches(f("a"), f("b")).alias("x"), M.edited_branches(f("a"), f("a")).alias("y")).first()
    assert [tuple(x) for x in got.x] == [(2, 2)] and got.y == []


def test_sql_agrees(spark, tmp_path):
    rows = [(d, t) for d, t in ROWS if d is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r for r in db.sql(M.SQL["op1_merkle_fingerprints"]).fetchall()}
    got = {r.doc_id: tuple(r) for r in M.op1_merkle_fingerprints(spark, str(tmp_path)).collect()}
    assert got == want


def test_an_id_with_very_many_rows_is_parted(spark, monkeypatch):
    rows = [(None if i % 3 else i, f"Text {i}. More {i * 7} here.\nEnd {i % 4}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(M, "RANGE_BYTES", 300)
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("__key"), F.xxhash64("text").alias("__tie"))
    edges = M._edges(keyed, 40)
    assert sum(len(t) for _, t in edges) >= 30 and max(len(t) for _, t in edges) >= 20
    sizes = [r["count"] for r in keyed.groupBy(M._number(edges).alias("r")).count().collect()]
    assert max(sizes) < 40 and len(sizes) >= 30
    order = sorted((r["__key"], r["__tie"], r["text"]) for r in keyed.collect())
    want = []
    for i, (_, _, t) in enumerate(order):
        nxt, h = order[(i + 1) % len(order)][2], len(t) // 2
        want.append((t, sha(t[: len(t) - h] + nxt[:h])))
    joined = M.compare_with_edits(docs).join(docs.select("text", M.encoded(F.col("text"), M.tree(F.col("text"))).alias("fingerprint")), "fingerprint")
    assert sorted((r.text, r.edited_sha256) for r in joined.collect()) == sorted(want)
