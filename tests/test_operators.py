import json
import random

import pytest
from pyspark.sql import functions as F

from litloom.errors import AuthenticationError, NetworkError, ProviderError
from litloom.functions.similarity import ratio
from litloom.operators import dedup, ranking, screening, structure
from litloom.sinks import exports
from litloom.sources import normalize, providers, readers


def records(spark, rows):
    schema = "idx long, title string, year int, doi string, arxiv_id string, provider string, abstract string, cited_by_count int, url string, authors array<struct<family_name:string,given_name:string,orcid:string>>, venue string, provider_id string"
    full = [tuple({"idx": i, "provider": "s2", "authors": [], **r}.get(k) for k in ("idx", "title", "year", "doi", "arxiv_id", "provider", "abstract", "cited_by_count", "url", "authors", "venue", "provider_id")) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, schema)


def brute_clusters(rows, threshold, gap):
    n, root = len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def union(i, j):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)

    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if a.get("doi") and a.get("doi") == b.get("doi") or a["title"] == b["title"]:
                union(i, j)
            elif a.get("year") and b.get("year") and abs(a["year"] - b["year"]) <= gap:
                if len(set(a["title"].split()) & set(b["title"].split())) >= 2 and ratio(a["title"], b["title"]) >= threshold:
                    union(i, j)
    labels = [find(i) for i in range(n)]
    number = {x: k for k, x in enumerate(sorted(set(labels)))}
    return [number[x] for x in labels]


def test_conservative_against_brute_force(spark):
    r = random.Random(3)
    vocab = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]
    rows = []
    for _ in range(120):
        t = " ".join(r.choice(vocab) for _ in range(r.randint(3, 6)))
        if r.random() < 0.3 and rows:
            t = r.choice(rows)["title"] + r.choice(["", "s", " x"])
        rows.append({"title": t, "year": r.choice([None, 2000, 2001, 2003]), "doi": r.choice([None, None, None, f"10.1/{r.randint(0, 40)}"])})
    got = {x.idx: x.cluster_id for x in dedup.conservative(records(spark, rows), threshold=85).collect()}
    assert [got[i] for i in range(len(rows))] == brute_clusters(rows, 85, 1)


def test_golden_record(spark):
    rows = [
        {"title": "A", "provider": "arxiv", "abstract": "x" * 30, "cited_by_count": 9, "arxiv_id": "1", "authors": [("Lee", "Ann", "0-1")], "year": 2019},
        {"title": "B", "provider": "crossref", "abstract": "No abstract available", "doi": "10.1/a", "authors": [("Lee", "A.", None), ("Roe", None, None)]},
        {"title": "C", "provider": "pubmed", "abstract": "y" * 30, "cited_by_count": 3, "authors": [("lee", "Al", "0-2")]},
    ]
    docs = records(spark, rows).withColumn("cluster_id", F.lit(0))
    fused = dedup.golden_records(docs)
    x = dedup.enrich_orcids(fused, docs).first()
    assert (x.title, x.provider, x.abstract, x.doi, x.arxiv_id, x.year, x.cited_by_count, x.url, x["size"]) == ("B", "crossref", "x" * 30, "10.1/a", "1", 2019, 9, "https://doi.org/10.1/a", 3)
    assert [(a.family_name, a.orcid) for a in x.authors] == [("Lee", "0-2"), ("Roe", None)]


def test_semantic(spark):
    docs = records(spark, [{"title": f"t{i}", "year": 2000} for i in range(6)])
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [0.1, 1.0]), (4, [-1.0, 0.0]), (5, [0.0, 0.0])], "idx long, embedding array<double>")
    got = {x.idx: x.cluster_id for x in dedup.semantic(docs, vectors).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 3}


def test_exports(spark):
    rows = [
        {"title": "Deep <a> learning & more", "year": 2020, "authors": [("Smith", "John", None), ("Roe", "R", None)], "venue": "Journal of X", "abstract": "An abstract of words. " * 20, "doi": "10.1/a", "url": "u", "cited_by_count": 4},
        {"title": "Deep things", "year": 2020, "authors": [("Smith", "Jane", None)], "venue": "Conference on Y", "doi": "10.1/b"},
    ]
    docs = records(spark, rows)
    a, b = exports.bibtex(docs, 50).orderBy("idx").collect()
    assert (a.cite_key, b.cite_key) == ("Smith2020Deep", "Smith2020Deepa")
    assert a.entry.startswith("@article{Smith2020Deep,") and b.entry.startswith("@inproceedings{") and "\\& more" in a.entry
    assert ("An abstract of words. " * 20)[:47] + "..." in a.entry
    r = exports.ris(docs).orderBy("idx").first().entry.split("\n")
    assert r[0] == "TY  - JOUR" and r[-1] == "ER  - " and r[2:4] == ["AU  - Smith, John", "AU  - Roe, R"] and "PY  - 2020" in r and "DO  - 10.1/a" in r


def test_write_and_read(spark, tmp_path):
    docs = records(spark, [{"title": 'T "q", x', "year": 2020, "authors": [("Lee", "Ann", None)], "cited_by_count": 0}])
    for kind in ("csv", "jsonl", "bibtex", "ris"):
        exports.write(docs, str(tmp_path / kind), kind, single_file=True)
    back = readers.csv(spark, str(tmp_path / "csv")).first()
    assert back.title == 'T "q", x' and back.authors[0].family_name == "Lee" and back.cited_by_count is None
    exports.write_json_array(docs, str(tmp_path / "a.json"))
    (part,) = (tmp_path / "a.json").glob("part-*")
    assert json.loads(part.read_text())[0]["title"] == 'T "q", x'
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "x.jsonl").write_text('{"title": "a", "year": 2000}\n\n{"title": ""}\nbroken\n')
    good, bad = readers.jsonl(spark, str(tmp_path / "r"))
    assert good.count() == 1 and bad.count() == 2
    for p in ("openalex", "dedup_1"):
        (tmp_path / "run" / p).mkdir(parents=True)
        (tmp_path / "run" / p / "all_results.jsonl").write_text('{"title": "a"}\n')
    assert readers.runs(spark, str(tmp_path / "run")).count() == 1


def test_queries_file():
    rows = readers.flatten_queries({"queries": [{"id": "A", "theme": "t", "query": "x", "include_any": ["i"]}, {"text": "y"}]})
    assert [(r["query_id"], r["category"], r["text"]) for r in rows] == [("A", "t", "x"), ("Q02", "general", "y")]
    rows = readers.flatten_queries({"c1": ["a", "b"], "c2": ["c"]})
    assert [r["query_id"] for r in rows] == ["Q01", "Q02", "Q03"] and rows[2]["category"] == "c2"
    assert readers.latest_run(["x/run_2024-01-01_000000", "x/run_2024-02-01_000000/", "x/dedup_9"]) == "run_2024-02-01_000000"


def test_saved_responses(spark, tmp_path):
    (tmp_path / "p1.json").write_text(json.dumps({"results": [{"id": "https://openalex.org/W5", "display_name": "T", "publication_year": 2020}, {"id": "x"}]}))
    got = providers.normalizer("openalex")(providers.saved(spark, f"{tmp_path}/p*.json", "openalex")).collect()
    assert [(r.title, r.year, r.external_ids.openalex_id, r.provider_id) for r in got] == [("T", 2020, "W5", "W5")]
    (tmp_path / "c.json").write_text(json.dumps({"message": {"items": [{"title": [f"C{i % 3}"], "DOI": f"10.1/{i % 3}"} for i in range(9)]}}))
    assert sorted(r.title for r in providers.records(spark, f"{tmp_path}/c.json", "crossref").collect()) == ["C0", "C1", "C2"]
    assert providers.records(spark, f"{tmp_path}/c.json", "crossref", most=2).count() == 2
    entry = '<entry><id>http://arxiv.org/abs/2301.{0}v1</id><title>T {0}</title><summary>s</summary><published>2023-01-0{0}T00:00:00Z</published><author><name>A B</name></author><author><name>C D</name></author><arxiv:doi>10.1/{0}</arxiv:doi><arxiv:primary_category term="cs.CV"/></entry>'
    (tmp_path / "a.xml").write_text('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">' + "".join(entry.format(i) for i in (1, 2, 2)) + "</feed>")
    got = sorted(providers.records(spark, f"{tmp_path}/a.xml", "arxiv", "Q1").collect(), key=lambda r: r.title)
    assert [(r.title, r.external_ids.arxiv_id, r.external_ids.doi, r.venue, len(r.authors), r.query_id) for r in got] == [(f"T {i}", f"2301.{i}", f"10.1/{i}", "arXiv (cs.CV)", 2, "Q1") for i in (1, 2)]
    (tmp_path / "p.xml").write_text("<PubmedArticleSet>" + "".join(f"<PubmedArticle><MedlineCitation><PMID>{i}</PMID><Article><ArticleTitle>P{i}</ArticleTitle></Article></MedlineCitation></PubmedArticle>" for i in (4, 5)) + "</PubmedArticleSet>")
    assert sorted((r.title, r.provider_id) for r in providers.records(spark, f"{tmp_path}/p.xml", "pubmed").collect()) == [("P4", "4"), ("P5", "5")]


def test_guards_of_a_client():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    answers = iter([(503, None), (429, None), (200, "body"), (401, None)])
    ask = providers.guarded(lambda: next(answers), "crossref", sleep=sleep, clock=lambda: now[0])
    assert ask() == "body" and slept[:2] == [1.0, 2.0]
    with pytest.raises(AuthenticationError):
        ask()
    assert providers.error_for(200) is None and isinstance(providers.error_for(404), ProviderError)
    calls = []
    fast = providers.limited(providers.TokenBucket(2, 1, clock=lambda: now[0]), sleep)(lambda: calls.append(now[0]))
    for _ in range(3):
        fast()
    assert calls[2] - calls[0] >= 1.0
    book = {None: ([1, 2], "x"), "x": ([3, 4], "y"), "y": ([5], None)}
    assert providers.pages(book.get) == [1, 2, 3, 4, 5] and providers.pages(book.get, 3) == [1, 2, 3]
    tries = iter([(b"<html>", "text/html"), (b"%PDF-1", "application/pdf")])
    assert providers.download(lambda: next(tries), sleep=sleep) == b"%PDF-1"
    with pytest.raises(NetworkError):
        providers.download(lambda: (b"%PDF", "text/html; charset=x"), tries=2, sleep=sleep)
    assert providers.headers("core", "k")["Authorization"] == "Bearer k" and providers.tool("no-such-program") is None


def test_other_providers(spark):
    one = lambda raw: spark.createDataFrame([(raw,)], "raw string")
    s2 = normalize.semantic_scholar(one(json.dumps({"paperId": "p", "title": "T", "year": 2020, "externalIds": {"DOI": "10.1/X", "ArXiv": "1.2"}, "authors": [{"name": "A B"}]}))).first()
    assert (s2.external_ids.doi, s2.external_ids.arxiv_id, s2.authors[0].family_name) == ("10.1/x", "1.2", "B")
    xml = "<PubmedArticle><MedlineCitation><PMID>7</PMID><Article><Journal><Title>J</Title><JournalIssue><PubDate><MedlineDate>2019 Jan-Feb</MedlineDate></PubDate></JournalIssue></Journal><ArticleTitle>T</ArticleTitle><Abstract><AbstractText>a</AbstractText><AbstractText>b</AbstractText></Abstract><AuthorList><Author><LastName>L</LastName><ForeName>F</ForeName></Author></AuthorList><ELocationID EIdType=\"doi\">10.1/Q</ELocationID></Article></MedlineCitation></PubmedArticle>"
    p = normalize.pubmed(one(xml)).first()
    assert (p.title, p.year, p.abstract, p.external_ids.doi, p.external_ids.pubmed_id, p.authors[0].family_name) == ("T", 2019, "a b", "10.1/q", "7", "L")
    d = normalize.doaj(one(json.dumps({"id": "d", "bibjson": {"title": "T", "year": "2018", "identifier": [{"type": "doi", "id": "10.1/Z"}], "author": [{"name": "X Y"}], "link": [{"url": "u"}]}}))).first()
    assert (d.year, d.external_ids.doi, d.url) == (2018, "10.1/z", "u")
    a = normalize.arxiv(spark.createDataFrame([("http://arxiv.org/abs/2301.1v2", "T\n x", "s", "2023-01-01", [("A B",)], None, "cs.CV")], normalize.ARXIV_ROWS)).first()
    assert (a.title, a.year, a.external_ids.arxiv_id, a.venue) == ("T x", 2023, "2301.1", "arXiv (cs.CV)")
    g = normalize.generic(one(json.dumps({"a": {"t": "T"}, "y": "May 2001", "n": ["P Q"]})), {"title": "a.t", "year": "y", "authors": "n"}, "x").first()
    assert (g.title, g.year, len(g.provider_id), g.authors[0].family_name) == ("T", 2001, 16, "Q")


def test_limits_and_retries():
    now = [0.0]
    bucket = providers.TokenBucket(2, 2, clock=lambda: now[0])
    assert [bucket.consume() for _ in range(3)] == [True, True, False] and bucket.wait_time() == pytest.approx(0.5)
    now[0] = 1.0
    assert bucket.consume()
    window = providers.SlidingWindow(2, 10, clock=lambda: now[0])
    assert [window.allow() for _ in range(3)] == [True, True, False]
    now[0] = 12.0
    assert window.allow()
    calls, waits = [], []

    def fails():
        calls.append(1)
        if len(calls) < 3:
            raise providers.NetworkError("x")
        return "done"

    assert providers.with_retries(fails, sleep=waits.append)() == "done" and waits == [1.0, 2.0]


def test_screening(spark):
    docs = spark.createDataFrame([(0, "Deep", "a"), (1, "weeds", None), (2, "other", "b")], "idx long, title string, abstract string")

    class Odd(screening.RuleBackend):
        def judge(self, layer, title, abstract):
            if title == "other":
                raise ValueError("boom")
            return super().judge(layer, title, abstract)

    got = {r.idx: (r.decision, r.screening_confidence, len(r.screening_layers)) for r in screening.screen(docs, Odd(["deep"], ["weed"]), ["a", "b"]).collect()}
    assert got == {0: ("include", 90, 2), 1: ("exclude", 90, 1), 2: ("maybe", 0, 2)}
    first = docs.withColumns({"decision": F.lit("exclude"), "screening_reason": F.lit("r")})
    again = spark.createDataFrame([(9, " DEEP ", "include", "n")], "idx long, title string, decision string, screening_reason string")
    merged = {r.idx: (r.decision, r.screening_reason) for r in screening.with_recovery(first, again).collect()}
    assert merged == {0: ("include", "n"), 1: ("exclude", "r"), 2: ("exclude", "r")}


def test_fuzzy_venues(spark):
    docs = spark.createDataFrame([("Plant Methods",), ("Frontiers in Plant Science",), ("methods plant",), ("Zoology",), (None,)], "venue string")
    got = {r.venue: r.matched for r in ranking.rank_venues(docs, ["Plant Methods", "Plant Science"]).collect()}
    assert got == {"Plant Methods": "Plant Methods", "Frontiers in Plant Science": "Plant Science", "methods plant": "Plant Methods", "Zoology": None, None: None}


def test_chunks_and_tables(spark):
    text = "# A\nintro\n\n## Methods\n" + "\n\n".join(["word " * 30] * 5) + "\n\n![x](a/b.png)\n\nFigure 1. cap\n# B\nlast"
    chunks = structure.chunk_pages(spark.createDataFrame([("f", 1, text), ("f", 2, "on page two")], "source_file string, page_number int, text string"), 400).collect()
    assert [(c.section, c.part, c.total_parts) for c in chunks] == [("A", 1, 1), ("Methods", 1, 3), ("Methods", 2, 3), ("Methods", 3, 3), ("B", 1, 1)]
    assert chunks[1].hierarchy == "A > Methods" and chunks[1].section_role == "methods" and chunks[3].images == ["b.png"] and chunks[4].text == "last\non page two"
    t = "source_file string, table_id string, page_number int, headers array<string>, rows array<array<string>>, caption string"
    tables = spark.createDataFrame([("f", "a", 1, ["X", "Y"], [["1", "2"]], "Table 1"), ("f", "b", 2, ["X", "Y"], [["x", "y"], ["3", "4"]], None), ("f", "c", 3, None, [["5", "6"]], "Table 1 continued"), ("f", "d", 4, ["Q"], [["7"]], "Table 2")], t)
    got = structure.merge_continuations(tables).orderBy("table_id").collect()
    assert [(r.table_id, len(r.rows), r.last_page) for r in got] == [("a", 3, 3), ("d", 1, 4)]
    raw = spark.createDataFrame([(["Table 1 Groups of", "x"], [["a", "", "b"], ["", "", ""]])], "h array<string>, r array<array<string>>")
    h, r = structure.without_empty(F.array(F.lit("A"), F.lit(""), F.lit("C")), F.col("r"))
    got = raw.select(structure.merge_headers(F.col("h")).alias("m"), h.alias("h"), r.alias("r"), structure.is_sparse(F.col("r"), F.lit(3)).alias("s"), structure.as_markdown(F.array(F.lit("A")), F.array(F.array(F.lit("1")))).alias("md")).first()
    assert (got.m, got.h, got.r, got.s, got.md) == (["Groups of x"], ["A", "C"], [["a", "b"]], False, "| A |\n| --- |\n| 1 |")


def test_citation_links(spark):
    lib = spark.createDataFrame([("f", 1, "Smith, J", "T", 2020), ("f", 2, "Doe", "U", 2019)], "source_file string, number int, authors string, title string, year int")
    chunks = spark.createDataFrame([("c", "f", "see [2] and [9]")], "id string, source_file string, text string")
    assert [r.number for r in structure.link_numbers(chunks, lib).collect()] == [2]
    cites = spark.createDataFrame([("f", "Smith, 2020"), ("f", "Nobody, 1999")], "source_file string, citation string")
    assert [(r.citation, r.number) for r in structure.link_author_dates(cites, lib).collect()] == [("Smith, 2020", 1)]


def test_stream(spark, tmp_path):
    from litloom.streaming import windows

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"title": "a", "provider": "p", "query_id": "q", "at": "2024-01-01 00:00:00"}\n' * 2)
    schema = "title string, provider string, query_id string, at timestamp"
    for _ in range(2):
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        q = windows.append(windows.first_records(stream, "title", "at", "1 hour"), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
