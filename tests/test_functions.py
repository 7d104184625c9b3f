import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from litloom import dsl
from litloom.errors import QueryError
from litloom.functions import citations, dates, ids, numbers, people, similarity, text
from litloom.schema import compile_schema


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_years_and_dates(spark):
    got = column(spark, ["2023-01-01", "2022", "May 2020", "invalid", "1850", None, "year 1850 or 1999"], dates.extract_year)
    assert got == [2023, 2022, 2020, None, None, None, 1999]
    assert str(column(spark, ["2023-01-15"], dates.parse_date)[0]) == "2023-01-15 00:00:00"
    assert column(spark, ["2023/01/15", "2023-01-15T10:11:12Z", "15/01/2023", "x"], dates.parse_date)[3] is None


def test_names(spark):
    got = column(spark, ["Doe, John", "Jane Smith", "SingleName", "", None], people.split_name)
    assert [(r.family_name, r.given_name) for r in got] == [("Doe", "John"), ("Smith", "Jane"), ("SingleName", None), ("Unknown", None), ("Unknown", None)]
    got = column(spark, ["Ann B. Lee", "Lee"], people.split_last_space)
    assert [(r.family_name, r.given_name) for r in got] == [("Lee", "Ann B."), ("Lee", None)]


def test_identifiers(spark):
    assert column(spark, ["https://doi.org/10.1/A", "doi: 10.1/a", " 10.1/a ", "HTTP://DX.DOI.ORG/10.1/a", "", None], ids.normalize_doi) == ["10.1/a"] * 4 + [None, None]
    assert column(spark, ["http://arxiv.org/abs/2301.001v2", "x"], ids.arxiv_from_url) == ["2301.001", None]


def test_titles(spark):
    assert column(spark, ["Étude  naïve-x!", " A\tB ", None], text.normalize_title) == ["etude naivex", "a b", None]
    assert column(spark, ["a\\b & c_d {e} 5%"], text.escape_latex) == ["a\\textbackslash{}b \\& c\\_d \\{e\\} 5\\%"]


def test_numbers(spark):
    assert column(spark, ["98.5%", "54,306 images", "none", "-1e3"], numbers.parse_number) == [98.5, 54306.0, None, -1000.0]
    assert column(spark, ['"NR"', "[]", "{}", "null", None, "5", '"x"'], numbers.classify_json) == ["nr", "empty_list", "empty_object", "missing", "missing", "value", "value"]
    assert column(spark, ["acc 93.5%", "12%", "x"], numbers.extract_accuracy) == [93.5, None, None]


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_similarity():
    import random

    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in range(2))
        assert similarity.lcs_length(a, b) == brute_lcs(a, b)
    assert similarity.token_set("a b c", "c a") == 100 and similarity.token_set("", "a") == 0


def test_citations(spark):
    assert column(spark, ["see [1], [2,3] and [4-6] [1-2,9]"], citations.citation_numbers) == [[1, 2, 3, 4, 5, 6]]
    got = column(spark, ['Smith, J. (2020). "A title". doi:10.1/x.'], citations.parse_reference)[0]
    assert (got.authors, got.title, got.year, got.doi) == ("Smith, J.", "A title", 2020, "10.1/x")


def test_dsl_strings():
    q = 'title:"Deep Learning" AND author:Smith'
    assert dsl.to_provider("arxiv", q) == 'ti:"Deep Learning" AND au:Smith'
    assert dsl.to_provider("pubmed", q) == '"Deep Learning"[Title] AND Smith[Author]'
    assert dsl.to_provider("ieee", q) == 'article_title:"Deep Learning" AND author:Smith'
    assert dsl.to_provider("arxiv", "(title:Deep OR title:Neural) AND author:Smith") == "(ti:Deep OR ti:Neural) AND au:Smith"
    assert dsl.to_bulk('a AND "b c" or NOT d') == 'a + "b c" | -d'
    assert dsl.to_structured("title:a title:b c", {"title": "t"}, year_min=2000) == {"t": {"$or": ["a", "b"]}, "any": "c", "filters": {"year_min": 2000}}
    p = dsl.provider_params("openalex", "x", 2020, 2020)
    assert p["search"] == "x" and "publication_year:2020" in p["filter"] and "type:article" in p["filter"]
    assert "from-pub-date:2021" in dsl.provider_params("crossref", "x", 2021)["filter"]
    with pytest.raises(QueryError):
        dsl.to_provider("arxiv", "(a")
    assert dsl.to_provider("arxiv", "(a", strict=False) == "(a"


def test_dsl_predicates(spark):
    rows = [(1, "Deep maps", "about trees", "J1", 2020), (2, "Neural maps", None, "J2", 2021), (3, "trees", "deep", None, None)]
    df = spark.createDataFrame(rows, "id int, title string, abstract string, venue string, year int")
    find = lambda q: [r.id for r in df.where(dsl.to_column(q)).orderBy("id").collect()]
    assert find("maps") == [1, 2] and find("deep") == [1, 3] and find("title:deep") == [1]
    assert find("maps NOT year:2020") == [2] and find("title:(deep OR neural) J2") == [2] and find("trees OR year:2021") == [1, 2, 3]
    for bad in ("", "a AND", "(a", "a)", "NOT"):
        with pytest.raises(QueryError):
            dsl.to_column(bad)


def test_schema_compiler():
    s = compile_schema([{"id": "a", "type": "list of strings"}, {"id": "b", "type": "object", "object_fields": {"x": "float"}}, {"id": "c", "type": "integer"}])
    assert s.simpleString() == "struct<a:array<string>,b:struct<x:string>,c:string>"


def test_year_of_a_reference_is_not_a_number_in_a_name(spark):
    got = column(spark, ['Author 1950, B. (1990).', "Another 1950, no bracket 2003", "Lee, A. Of maps. 2011. doi:10.1/1999"], citations.parse_reference)
    assert [(x.authors, x.year) for x in got] == [("Author 1950, B.", 1990), ("Another 1950, no bracket", 2003), ("Lee, A. Of maps", 2011)]


def test_marks_of_every_character_without_python(spark):
    import sys
    import unicodedata

    from litloom.functions.text import without_marks

    texts = [None, "plain"] + ["".join(chr(i) for i in range(at, min(at + 64, sys.maxunicode + 1)) if not 0xD800 <= i <= 0xDFFF) for at in range(0, sys.maxunicode + 1, 64)]
    want = [t and "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)) for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "x string").select(without_marks(F.col("x")).alias("y"))
    assert "EvalPython" not in df._jdf.queryExecution().toString()
    assert [r.y for r in df.collect()] == want


def test_packed_texts_against_one_another():
    r = random.Random(3)
    texts = ["".join(r.choice("abc é") for _ in range(r.choice([0, 1, 63, 64, 65, 128, 150]))) for _ in range(30)]
    packed, which = similarity.Packed(texts), list(range(0, 30, 2))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for t in texts[:12]:
        assert packed.common(t, np.array(which)).tolist() == [similarity.lcs_length(t, texts[k]) for k in which]
        assert packed.edits(t, np.array(which)).tolist() == [edits(t, texts[k]) for k in which]


def test_a_response_is_parsed_once(spark):
    import json

    from litloom.sources import normalize

    raw = json.dumps({"id": "https://openalex.org/W1", "display_name": "a b a", "abstract_inverted_index": {"a": [0, 2], "b": [1]}})
    out = normalize.openalex(spark.createDataFrame([(raw,)], "raw string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert max(plan.count("parseJson"), plan.count("parse_json")) == 1
    assert out.first().abstract == "a b a"
