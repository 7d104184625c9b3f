import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(n for n in __import__("litloom.plans.catalogue", fromlist=["x"]).oracle_sql())


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    from litloom.plans import catalogue

    query, sql = catalogue.queries()[name], catalogue.oracle_sql()[name]
    assert compare(spark, query, sql, FOLDER, db) == ""


def test_fuzzy_clusters_against_all_pairs(spark):
    """The one query without SQL, as it needs common subsequences."""
    from litloom.functions import ids
    from litloom.functions.similarity import ratio
    from litloom.functions.text import normalize_title
    from litloom.plans import bib, corpus

    rows = bib.documents(spark, FOLDER).select("idx", normalize_title(F.col("title")).alias("norm"), "year", ids.normalize_doi(F.col("doi")).alias("doi"), "arxiv_id").orderBy("idx").collect()
    root = {r.idx: r.idx for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    words = {r.idx: set(r.norm.split()) for r in rows}
    for n, b in enumerate(rows):
        for a in rows[:n]:
            same = any(x and x == y for x, y in ((a.doi, b.doi), (a.arxiv_id, b.arxiv_id), (a.norm, b.norm)))
            near = a.norm and b.norm and a.year and b.year and abs(a.year - b.year) <= 1 and len(words[a.idx] & words[b.idx]) > 1 and 100 * abs(len(a.norm) - len(b.norm)) <= 30 * (len(a.norm) + len(b.norm))
            if same or (near and ratio(a.norm, b.norm) >= 70 - 1e-9):
                x, y = find(a.idx), find(b.idx)
                root[max(x, y)] = min(x, y)
    number = {x: k for k, x in enumerate(sorted({find(r.idx) for r in rows}))}
    assert {r.idx: r.cluster_id for r in corpus.dedup_fuzzy_clusters(spark, FOLDER).collect()} == {r.idx: number[find(r.idx)] for r in rows}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    llm = {n for n in entry.queries() if n.startswith("op") or n == "pipeline"}
    assert set(entry.queries()) - llm - set(entry.oracle_sql()) == {"dedup_fuzzy_clusters"}
