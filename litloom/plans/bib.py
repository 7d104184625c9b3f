"""The bibliographic view of the driver's `documents`, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES_ROWS = [
    ("Q0", ["the", "der"], ["stupid"]),
    ("Q1", [], ["apache", "idiot"]),
    ("Q2", ["que", "und", "th"], []),
    ("Q3", [], []),
]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, title, abstract, year, provider, venue, doi, arxiv_id, cited_by_count, language, query_id, authors, url."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    title = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    word = lambda n: F.coalesce(F.regexp_extract(title, rf"^(?:[^a-zA-Z]*[a-zA-Z]+){{{n}}}[^a-zA-Z]*([a-zA-Z]+)", 1), F.lit(""))
    author = lambda n: F.struct(word(n).alias("family_name"), F.nullif(word(n + 1), F.lit("")).alias("given_name"), F.lit(None).cast("string").alias("orcid"))
    return d.select(
        F.col("doc_id").alias("idx"),
        title.alias("title"),
        F.col("text").alias("abstract"),
        F.when(F.col("doc_id") % 17 != 0, (2000 + F.col("doc_id") % 25).cast("int")).alias("year"),
        F.element_at(F.array(*map(F.lit, ("openalex", "crossref", "arxiv", "pubmed", "s2"))), (F.col("doc_id") % 5 + 1).cast("int")).alias("provider"),
        F.col("source").alias("venue"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("10.1000/"), F.substring(F.sha2(title, 256), 1, 8))).alias("doi"),
        F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("2301."), (F.col("doc_id") % 500).cast("string"))).alias("arxiv_id"),
        (F.col("n_chars") % 500).cast("int").alias("cited_by_count"),
        F.col("lang").alias("language"),
        F.concat(F.lit("Q"), (F.col("doc_id") % 4).cast("string")).alias("query_id"),
        F.when(F.col("doc_id") % 11 == 0, F.array().cast("array<struct<family_name:string,given_name:string,orcid:string>>")).otherwise(F.array(author(0), author(2))).alias("authors"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string"))).alias("url"),
        F.concat(F.lit("P-"), F.col("doc_id").cast("string")).alias("provider_id"),
    )


def queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERIES_ROWS, "query_id string, include_any array<string>, exclude_any array<string>")


def _word(n: int) -> str:
    return f"coalesce(regexp_extract(title, '^(?:[^a-zA-Z]*[a-zA-Z]+){{{n}}}[^a-zA-Z]*([a-zA-Z]+)', 1), '')"


BIB = f"""base as (select doc_id, text, lang, source, n_chars, split_part(coalesce(text, ''), chr(10), 1) as title from documents),
bib as (select doc_id as idx, title, text as abstract, case when doc_id % 17 <> 0 then (2000 + doc_id % 25)::int end as year,
(['openalex', 'crossref', 'arxiv', 'pubmed', 's2'])[doc_id % 5 + 1] as provider, source as venue,
case when doc_id % 3 = 0 then '10.1000/' || left(sha256(title), 8) end as doi, case when doc_id % 7 = 0 then '2301.' || (doc_id % 500) end as arxiv_id,
(n_chars % 500)::int as cited_by_count, lang as language, 'Q' || (doc_id % 4) as query_id,
case when doc_id % 11 = 0 then [] else [{{'family_name': {_word(0)}, 'given_name': nullif({_word(1)}, '')}}, {{'family_name': {_word(2)}, 'given_name': nullif({_word(3)}, '')}}] end as authors,
case when doc_id % 2 = 0 then 'https://example.org/' || doc_id end as url, 'P-' || doc_id as provider_id from base)"""

_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::varchar[]"
ASKED = "asked(query_id, include_any, exclude_any) as (values " + ", ".join(f"('{q}', {_list(i)}, {_list(x)})" for q, i, x in QUERIES_ROWS) + ")"

NORM = """trim(regexp_replace(trim(regexp_replace(lower(strip_accents(title)), '\\s+', ' ', 'g')), '[^\\p{L}\\p{N}_\\s]', '', 'g'))"""

#: Connected components of `edges(a, b)` over the nodes of `nodes(n)`, as (n, label).
CLOSURE = """both_ways as (select a, b from edges union select b, a from edges),
reach(n, l) as (select n, n from nodes union select e.b, r.l from reach r join both_ways e on r.n = e.a),
labels as (select n, min(l) as label from reach group by n)"""


def with_(*parts: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(parts) + "\n"
