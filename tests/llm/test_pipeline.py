import random
from collections import Counter

import __spark_entry__ as entry
import corpus_pipeline as P
from litloom.llm import packing
from tests.llm.test_language_id import WORDS
from tests.llm.test_minhash import brute as brute_groups
from tests.llm.test_suffix_dedup import brute as brute_cuts


def corpus():
    r = random.Random(9)
    rows = []
    for i in range(120):
        lang = r.choice(list(WORDS))
        text = " ".join(r.choice(WORDS[lang].split()) + r.choice("abcdefgh") * r.randint(0, 2) for _ in range(r.randint(8, 60)))
        rows.append((i, text, lang, r.choice(["s1", "s2", None]), len(text)))
    rows += [(200 + i, rows[i][1], "en", "s1", 1) for i in range(6)]
    rows += [(300, "12 34 !!", "en", "s1", 8), (301, None, None, "s1", 0), (302, "", "en", "s2", 0)]
    passage = " ".join(r.choice(WORDS["en"].split()) for _ in range(40))
    rows += [(400 + i, rows[i][1] + " " + passage + " " + rows[i + 1][1], "en", "s2", 1) for i in range(20, 26)]
    return rows


def test_stages(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = docs.columns, docs
    results = {}
    for k, (name, stage) in enumerate(P.STAGES):
        kept = stage(spark, kept, str(tmp_path))
        kept.write.parquet(str(tmp_path / f"stage{k}"))
        kept = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if k < len(P.STAGES) - 1:
            assert kept.columns == columns
        results[name] = kept.collect()
    texts = {r[0]: r[1] for r in rows}
    known = {r.doc_id: r.text for r in results["language_id"]}
    assert set(known) == {d for d, t in texts.items() if t and any(c.isalpha() for c in t)}
    want = {d for d, _, _, keep in brute_groups(list(known.items())) if keep}
    assert {r.doc_id for r in results["minhash_dedup"]} == want
    left = [(d, known[d]) for d in sorted(want)]
    cuts = {d: n - gone for d, n, gone, _, _ in brute_cuts(left)}
    assert {r.doc_id: len(r.text.encode()) for r in results["suffix_dedup"]} == {d: n for d, n in cuts.items() if n}
    assert all(r.n_chars == len(r.text) for r in results["suffix_dedup"] if cuts[r.doc_id] < len(known[r.doc_id].encode()))
    clean = {r.doc_id: r.text for r in results["suffix_dedup"]}
    taken = Counter(r.doc_id for r in results["mixing"])
    assert set(taken) <= set(clean) and max(taken.values()) <= 3 and all(r.text == clean[r.doc_id] for r in results["mixing"])
    ids = packing.WordIds(packing.vocabulary_path())
    tokens = Counter()
    for r in results["packing"]:
        tokens[r.doc_id] += r.length
    assert tokens == {d: n * (len(ids.of(clean[d])) // 4 + 1) for d, n in taken.items()}
    whole = P.run(spark, str(tmp_path))
    assert sorted(map(str, whole.drop("sequence_id").collect())) == sorted(str(r) for r in spark.read.parquet(str(tmp_path / "stage4")).drop("sequence_id").collect())


def test_empty_table_and_odd_rows_through_run(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(random.Random(1).choice(WORDS["de"].split()) + str(i) for i in range(60_000))
    rows = [(None, "der die und nicht eine mit", "de", None, 1), (None, None, None, None, None), (7, long, "de", "s", 1), (7, long, "de", "s", 1), (8, "the of and to in that with", "en", "s", 1)] + [(20 + i, f"the of and to in that with {i} which from", "en", "s", 1) for i in range(12)]
    for name, data in (("none", []), ("odd", rows)):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
    assert P.run(spark, str(tmp_path / "none")).count() == 0
    got = P.run(spark, str(tmp_path / "odd")).collect()
    assert sum(r.length for r in got if r.doc_id == 7) % 2 in (0, 1) and {r.doc_id for r in got} <= {None, 7, 8, *range(20, 32)}
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))


def test_registered():
    assert sorted(n.partition("_")[0] for n in entry.queries() if n.startswith("op")) == sorted(f"op{k}" for k in range(1, 11))
    assert "pipeline" in entry.queries() and len(P.STAGES) == 5
