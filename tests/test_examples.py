"""Small examples with their answers: what the queries over whole tables cannot show one by one."""

import json

from pyspark.sql import functions as F

from litloom import extensions
from litloom.errors import ConfigurationError, ExportError, ProviderNotFoundError
from litloom.functions import citations, numbers, people, sections
from litloom.operators import dedup, fulltext, ranking, reports, runs, stats, structure
from litloom.sinks import exports
from litloom.sources import normalize


def one(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select("id", *columns).orderBy("id").collect()]


def test_citations(spark):
    rows = [(1, "As in [1], [2, 4] and [5-7], not [1-2,9] nor (see Figure 1, 2020) but (Doe et al., 2019)."), (2, "Nothing"), (3, "Range [3–5] (Smith, 2020), twice [3].")]
    got = one(spark, "id int, t string", rows, citations.citation_numbers(F.col("t")), citations.author_date_citations(F.col("t")))
    assert got == [(1, [1, 2, 4, 5, 6, 7], ["Doe et al., 2019"]), (2, [], []), (3, [3, 4, 5], ["Smith, 2020"])]


def test_sections_names_and_facts(spark):
    heads = [(1, "2 Materials and Methods", None), (2, "Results and Discussion", "Paper > Results and Discussion"), (3, "Thanks", ""), (4, "Conclusions", "Paper > Introduction")]
    assert [r[1] for r in one(spark, "id int, a string, b string", heads, sections.section_tags(F.col("a"), F.col("b")))] == [["methods"], ["results", "discussion"], [], ["introduction", "conclusion"]]
    names = [(1, "Doe, John"), (2, "Jane Q. Smith"), (3, "SingleName"), (4, ""), (5, "  van Dyke,  A B ")]
    assert [tuple(r[1])[:2] for r in one(spark, "id int, n string", names, people.split_name(F.col("n")))] == [("Doe", "John"), ("Smith", "Jane Q."), ("SingleName", None), ("Unknown", None), ("van Dyke", "A B")]
    facts = [(1, '"98.5%"'), (2, '"NR"'), (3, None), (4, '"n/a "'), (5, "0.5"), (6, "[]"), (7, '{"k": 1}'), (8, "{}"), (9, "null")]
    assert [r[1] for r in one(spark, "id int, v string", facts, numbers.classify_json(F.col("v")))] == ["value", "nr", "missing", "nr", "value", "empty_list", "value", "empty_object", "missing"]


def test_reference_headings(spark):
    yes = ["## Reference", "## Works  Cited", "# Work Cited", "x\n  **References**  \ny", "BIBLIOGRAPHY", "###### **Literature Cited**"]
    no = ["1. References", "Reference list", "Literature Cited", "see references below", "## References and notes", "References:"]
    rows = [(i, t) for i, t in enumerate(yes + no)]
    assert [r[1] for r in one(spark, "id int, t string", rows, structure.opens_references(F.col("t")))] == [True] * 6 + [False] * 6


def test_continued_tables(spark):
    t = [("f", 1, "a", ["N", "Size"], [["1", "2"]], "Table 1: Sizes"), ("f", 2, "b", ["N", "Size"], [["N", "size"], ["3", "4"]], None), ("f", 3, "c", [], [["5", "6"]], "(continued)"), ("f", 5, "d", ["N", "Size"], [["7", "8"]], None), ("f", 6, "e", ["x"], [["9"]], "Table 2"), ("f", 7, "g", None, None, "Table 2 goes on")]
    got = structure.merge_continuations(spark.createDataFrame(t, "source_file string, page_number int, table_id string, headers array<string>, rows array<array<string>>, caption string")).orderBy("page_number").collect()
    assert [(r.table_id, r.page_number, r.last_page, r.rows, r.caption) for r in got] == [("a", 1, 3, [["1", "2"], ["3", "4"], ["5", "6"]], "Table 1: Sizes"), ("d", 5, 5, [["7", "8"]], None), ("e", 6, 7, [["9"]], "Table 2")]


def test_pubmed_authors_do_not_shift(spark):
    raw = "<PubmedArticle><PMID>1</PMID><ArticleTitle>T</ArticleTitle><AuthorList CompleteYN='Y'><Author><LastName>Alpha</LastName></Author><Author><LastName>Beta</LastName><ForeName>Bo</ForeName></Author><Author><CollectiveName>The Group</CollectiveName></Author></AuthorList></PubmedArticle>"
    got = normalize.pubmed(spark.createDataFrame([(raw,), (raw.replace("Author>", "Other>"),)], "raw string")).collect()
    assert [(a.family_name, a.given_name) for a in got[0].authors] == [("Alpha", None), ("Beta", "Bo"), ("The Group", None)]


def test_provider_records(spark):
    work = {"id": "https://openalex.org/W12", "display_name": "Deep Maps", "publication_year": 2021, "ids": {"doi": "https://doi.org/10.1/ABC"}, "authorships": [{"author": {"display_name": "Ann B. Lee", "orcid": None}}], "abstract_inverted_index": {"Maps": [0], "deep": [2], "are": [1]}, "cited_by_count": 7}
    r = normalize.openalex(spark.createDataFrame([(json.dumps(work),), ('{"id": "no title"}',)], "raw string")).collect()
    assert len(r) == 1 and (r[0].title, r[0].abstract, r[0].external_ids.doi, r[0].authors[0].family_name) == ("Deep Maps", "Maps are deep", "10.1/abc", "Lee")


def test_exports_of_clusters(spark, tmp_path):
    far = 3_000_000_000
    c = spark.createDataFrame([(far, "b", 1), (1, "a", 1)], "idx long, title string, cluster_id long")
    assert [m.title for m in exports.cluster_documents(c, ["title"]).first().members] == ["a", "b"]
    assert len(exports.CSV_COLUMNS) == 20 and exports.check_format(".CSV ") == "csv"
    for bad in (lambda: exports.check_format("doc"), lambda: exports.in_mode(c, "some"), lambda: exports.csv_clusters(c, "clusters")):
        try:
            bad()
            raise AssertionError
        except ExportError:
            pass
    exports.write_json_array(c.orderBy("idx"), str(tmp_path / "a"))
    text = "".join(r.value for r in spark.read.text(str(tmp_path / "a"), wholetext=True).collect())
    assert [x["title"] for x in json.loads(text)] == ["a", "b"]


def records(spark):
    rows = [(i, f"Title {i % 4}", 2000 + i % 3, ["openalex", "arxiv"][i % 2], f"Q{i % 3}", f"10.1/{i}", None, f"P{i % 9}", 5) for i in range(36)]
    return spark.createDataFrame(rows, "idx long, title string, year int, provider string, query_id string, doi string, arxiv_id string, provider_id string, cited_by_count int")


def test_a_run_is_written_and_taken_up_again(spark, tmp_path):
    queries = spark.createDataFrame([("Q0", "a AND b", "x"), ("Q1", "c", "x"), ("Q2", "d", "y")], "query_id string, text string, category string")
    plan = runs.selected(queries, include=["openalex", "arxiv"])
    assert plan.count() == 6 and runs.selected(queries, query_id="Q1", skip=["core"]).where("provider = 'core'").isEmpty()
    try:
        runs.selected(queries, include=["nobody"])
        raise AssertionError
    except ProviderNotFoundError:
        pass
    found = runs.collected(records(spark), most=3).where("query_id <> 'Q2'")
    folder = str(tmp_path / "run")
    runs.write_run(plan, found, folder, "run_1", formats=("jsonl", "csv"), year_min=2000)
    there = runs.read_results(spark, folder)
    todo, kept = runs.resumed(plan, there)
    assert {(r.query_id, r.provider) for r in todo.collect()} == {("Q2", "openalex"), ("Q2", "arxiv")} and kept.count() == found.count()
    meta = json.loads(spark.read.text(f"{folder}/metadata").first().value)
    assert meta["run_id"] == "run_1" and sum(meta["results"].values()) == found.count() and meta["query_details"][0]["translated_query"] == "all:a AND all:b"
    assert spark.read.text(f"{folder}/summary").collect()[-1].value == f"Total: {found.count()} documents"
    # One query anew replaces its partition alone.
    runs.write_results(records(spark).where("query_id = 'Q0' and provider = 'arxiv'").limit(1), folder)
    assert runs.read_results(spark, folder).count() == found.count() - found.where("query_id = 'Q0' and provider = 'arxiv'").count() + 1


def test_a_deduplication_is_written(spark, tmp_path):
    from litloom.plans.bib import documents

    docs = documents(spark, "/root/testdata/sf0.001")
    clustered = extensions.resolve(docs, "exact")
    runs.write_dedup(clustered, str(tmp_path / "out"))
    n = clustered.select("cluster_id").distinct().count()
    assert spark.read.text(str(tmp_path / "out" / "clusters")).count() == n == spark.read.csv(str(tmp_path / "out" / "representatives_csv"), header=True, multiLine=True, escape='"').count()


def test_extensions(spark):
    @extensions.PDF_SOURCES.add("mirror")
    def mirror(docs):
        return docs.withColumns({"pdf_url": F.when(F.col("doi").isNull(), F.lit("https://mirror/x.pdf")), "pdf_source": F.lit("mirror")})

    docs = spark.createDataFrame([(1, None, None, "10.1/a"), (2, None, None, None)], "idx long, url string, arxiv_id string, doi string")
    got = {r.idx: (r.pdf_url, r.pdf_source) for r in extensions.pdf_chain(docs, "links", "mirror").collect()}
    assert got == {1: ("https://doi.org/10.1/a", "doi"), 2: ("https://mirror/x.pdf", "mirror")}
    assert extensions.TRANSLATORS.get("ArXiv")("title:x", year_min=2000) == {"q": "ti:x", "year_min": 2000}
    try:
        extensions.EXPORTERS.get("doc")
        raise AssertionError
    except ConfigurationError:
        pass


def test_the_pipeline_of_a_paper(spark, tmp_path):
    pages = [("a.md", 1, "# Intro\nAs in [1] and (Smith, 2020).\n\n| A | B |\n|---|---|\n| 1 | 2 |"), ("a.md", 2, "## Results\nWords [2]."), ("a.md", 3, "## References\n[1] Doe, J. (2019). \"One\".\n[2] Smith, A. B. (2020). \"Two\"."), ("b.md", 1, "short")]
    frame = spark.createDataFrame(pages, "source_file string, page_number int, text string")
    chunks, library, tables = fulltext.process(frame, formulas=spark.createDataFrame([("a.md", 1, "x = 2")], "source_file string, page_number int, latex string"))
    got = {r.section: r for r in chunks.where("source_file = 'a.md'").collect()}
    assert set(got) == {"Intro", "Results"} and set(got["Intro"].citations) == {"1", "2"} and got["Intro"].citations["2"].type == "fuzzy_match" and got["Results"].citations["2"].type == "exact_number"
    assert got["Intro"].tables[0].headers == ["A", "B"] and got["Intro"].formulas[0].latex == "x = 2" and library.count() == 2
    counts = {r.source_file: r for r in fulltext.document_counts(structure.flag_references(frame), chunks, library, tables).collect()}
    assert (counts["a.md"].body_pages, counts["a.md"].reference_pages, counts["a.md"].citations, counts["a.md"].tables, counts["b.md"].tables) == (2, 1, 2, 1, 0)
    fulltext.write(chunks.drop("citations", "tables", "formulas"), library, tables, frame, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p" / "chunks")).count() == chunks.count()
    seen = fulltext.with_ocr(frame, lambda f, n: f"{f} {n} read").where("ocr").collect()
    assert {(r.source_file, r.text) for r in seen} >= {("b.md", "b.md 1 read")}
    done = fulltext.analyse(frame.withColumnRenamed("source_file", "paper_id"), lambda t: {"n": str(len(t))} if "Intro" not in t else 1 / 0).collect()
    assert sum(r.error is not None for r in done) == 1 and all(r.facts.get("n") for r in done if r.error is None)


def test_findings_and_venues(spark):
    d = spark.createDataFrame([(0, "", 0, "x1"), (1, "A", 1850, "10.1/a"), (2, "a ", 2040, None)], "idx long, title string, year int, doi string")
    assert {(r.level, r.message) for r in reports.findings(d).collect()} == {("error", "Document 1: Missing title"), ("warning", "Document 1: Missing year"), ("warning", "Document 1: Invalid DOI format: x1")}
    assert {r.message for r in reports.corpus_warnings(d).collect()} == {"2 documents have duplicate titles (potential duplicates)", "Suspiciously old year detected: 1850", "Future year detected: 2040"}
    v = spark.createDataFrame([("Plant Disease",), ("Sensors (MDPI)",), ("Journal of Plant Pathology Research",), ("Nothing",)], "venue string")
    got = {r.venue: r.matched for r in ranking.rank_venues(v).collect()}
    assert len(ranking.LEADING) == 64 and got["Plant Disease"] == "Plant Disease" and got["Sensors (MDPI)"] == "Sensors" and got["Nothing"] is None


def test_ranges(spark, monkeypatch):
    from litloom.operators import ranges

    monkeypatch.setattr(ranges, "RANGE_ROWS", 7)
    d = spark.createDataFrame([(i * 3 % 101, i % 5) for i in range(101)], "v long, w long")
    got = {r.v: r.b for r in ranges.running_before(d, "v", F.col("w"), "b").collect()}
    rows, total = dict((i * 3 % 101, i % 5) for i in range(101)), 0
    for v in sorted(rows):
        assert got[v] == total
        total += rows[v]
    x = spark.createDataFrame([(float(i % 13), float(-(i % 13))) for i in range(60)], "x double, y double")
    assert round(stats.spearman(x, "x", "y").first().r, 9) == -1.0


def test_prefixes_lose_no_pair(spark, monkeypatch):
    """Close titles by prefix filtering against all pairs, with common words in every title."""
    import random

    from litloom.functions.similarity import ratio

    monkeypatch.setattr(dedup, "COMMON", 3)
    r = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(160):
        t = ["of", "the", "a", *[r.choice(words) for _ in range(r.randint(1, 9))]]
        if i % 2 and rows:
            t = rows[-1][1].split()
            t[r.randrange(len(t))] = r.choice(words) + r.choice(["", "x"])
        r.shuffle(t) if i % 5 == 0 else None
        rows.append((i, " ".join(t), 2000 + r.randint(0, 2), None, None))
    d = spark.createDataFrame(rows, "idx long, title string, year int, doi string, arxiv_id string")
    for threshold in (97, 90, 75):
        got = {(x.a, x.b) for x in dedup.fuzzy_edges(dedup.prepared(d), threshold).collect()}
        seen = {}
        for i, t, y, _, _ in rows:
            seen.setdefault((t, y), i)
        items = [(i, t, y) for (t, y), i in seen.items()]
        want = {(min(a[0], b[0]), max(a[0], b[0])) for n, a in enumerate(items) for b in items[:n] if a[1] != b[1] and abs(a[2] - b[2]) <= 1 and len(set(a[1].split()) & set(b[1].split())) > 1 and ratio(a[1], b[1]) >= threshold}
        assert got == want and (threshold == 97 or got)


def test_semantic_join_is_exact(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(2)
    centres = r.standard_normal((12, 8))
    v = [(int(i), (centres[i % 12] + r.standard_normal(8) * 0.25).tolist()) for i in range(400)] + [(900, [0.0] * 8), (901, v0 := centres[0].tolist()), (902, v0)]
    x = np.array([a for _, a in v])
    n = np.linalg.norm(x, axis=1)
    c = (x @ x.T) / np.where(n > 0, n, 1)[:, None] / np.where(n > 0, n, 1)[None, :]
    want = {(v[i][0], v[j][0]) for i in range(len(v)) for j in range(i + 1, len(v)) if c[i, j] >= 0.92}
    got = [tuple(e) for e in dedup.semantic_edges(spark.createDataFrame(v, "idx long, embedding array<double>"), 0.92, block=16).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_semantic_links_join_what_the_pairs_join_and_stay_few(spark):
    from litloom.operators.graph import components

    v = [(i, [1.0, i % 2 * 0.01, 0.0]) for i in range(300)] + [(i, [0.0, 1.0, (i - 300) * 0.2]) for i in range(300, 306)] + [(900, None)]
    d = spark.createDataFrame(v, "idx long, embedding array<float>")
    pairs, links = dedup.semantic_edges(d, 0.92, block=64), dedup.semantic_edges(d, 0.92, block=64, links=True)
    assert pairs.count() > 300 * 299 / 2 and links.count() < 4 * 300
    assert {tuple(r) for r in components(pairs).collect()} == {tuple(r) for r in components(links).collect()}
