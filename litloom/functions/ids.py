"""Identifiers: normalising, extracting, deriving."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litloom.functions.text import strip, truthy


def normalize_doi(c: Column) -> Column:
    """Without resolver or prefix, lower case; empty becomes null."""
    bare = F.regexp_replace(F.regexp_replace(strip(c), r"(?i)^https?://(dx\.)?doi\.org/", ""), r"(?i)^doi:\s*", "")
    return F.nullif(F.lower(strip(bare)), F.lit(""))


def normalize_arxiv(c: Column) -> Column:
    return F.nullif(F.lower(strip(c)), F.lit(""))


def _found(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def arxiv_from_url(c: Column) -> Column:
    return _found(c, r"arxiv\.org/abs/(\d+\.\d+)(?:v\d+)?", 1)


def openalex_id(c: Column) -> Column:
    return _found(c, r"(W\d+)", 1)


def pubmed_id(c: Column) -> Column:
    return _found(c, r"(\d+)/?$", 1)


def ieee_number(provider_id: Column, url: Column) -> Column:
    return F.coalesce(_found(provider_id, r"^(\d+)$", 1), _found(url, r"document/(\d+)", 1))


def hashed_id(c: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(c, 256), 1, digits)


def provider_id(doi: Column, openalex: Column, arxiv: Column, s2: Column, title: Column) -> Column:
    """The first identifier there is, else a hash of the title."""
    first = [F.when(truthy(c), c) for c in (doi, openalex, arxiv, s2)]
    return F.coalesce(*first, hashed_id(title))


def pdf_name(doi: Column, arxiv: Column, title: Column) -> Column:
    base = F.when(truthy(doi), F.translate(doi, "/:", "__")).when(truthy(arxiv), F.concat(F.lit("arxiv_"), arxiv)).otherwise(F.concat(F.lit("doc_"), hashed_id(title)))
    return F.concat(base, F.lit(".pdf"))


def url_with_doi(url: Column, doi: Column) -> Column:
    """The DOI's resolver address unless the url is one."""
    lacks = truthy(doi) & ~F.contains(F.coalesce(url, F.lit("")), F.lit("doi.org"))
    return F.when(lacks, F.concat(F.lit("https://doi.org/"), doi)).otherwise(url)


def chunk_id(context: Column, content: Column) -> Column:
    return hashed_id(F.concat_ws("::", context, content))


def table_id(source_file: Column, page: Column, index: Column) -> Column:
    return hashed_id(F.concat(source_file, F.lit(":p"), page.cast("string"), F.lit(":t"), index.cast("string")), 12)
