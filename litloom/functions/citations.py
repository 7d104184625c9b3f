"""Reference entries and in-text citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litloom.functions.text import strip

NOT_AUTHORS = ("fig", "table", "eq", "section", "chapter", "page")


def _found(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def parse_reference(raw: Column) -> Column:
    """struct<raw_text, authors, title, year, doi> of one entry's text.

    The year is the first in brackets, else the last outside of identifiers and addresses, so a
    number that looks like one in a name is none.  Authors stand before it if it is far enough in,
    else before the first bracket.
    """
    bracketed, bare = r"(?s)^(.*?\()((?:19|20)\d{2})[a-z]?\)", r"(?s)^(.*)\b((?:19|20)\d{2})\b"
    rest = F.regexp_replace(raw, r"(?i)(?:doi[:\s]*|https?://)\S+", "")
    inside = raw.rlike(bracketed)
    year = F.when(inside, F.regexp_extract(raw, bracketed, 2)).otherwise(_found(rest, bare, 2))
    lead = F.when(inside, F.regexp_extract(raw, bracketed, 1)).otherwise(F.regexp_extract(rest, bare, 1))
    before = F.when(year.isNotNull() & (F.char_length(lead) > 10), F.regexp_replace(strip(lead), r"[()\[\],.:]+$", ""))
    opening = F.regexp_replace(strip(F.regexp_extract(raw, r"^([^(]+)", 1)), r"[,.:]+$", "")
    authors = F.coalesce(F.nullif(strip(before), F.lit("")), opening)
    return F.struct(
        strip(raw).alias("raw_text"),
        authors.alias("authors"),
        strip(_found(raw, r'["“”](.+?)["“”]', 1)).alias("title"),
        year.cast("int").alias("year"),
        F.regexp_replace(_found(raw, r"(?i)(?:doi[:\s]*|https?://doi\.org/)([^\s]+)", 1), r"\.+$", "").alias("doi"),
    )


def citation_numbers(text: Column) -> Column:
    """Numbers in [1], [1, 2] and [1-3]; a bracket that mixes ranges and commas is left out."""
    inside = F.regexp_extract_all(text, F.lit(r"\[(\d+(?:[,\-–]\s*\d+)*)\]"), 1)

    def numbers(x: Column) -> Column:
        ends = F.transform(F.split(x, "[-–]"), lambda e: strip(e).try_cast("int"))
        ranged = x.rlike("[-–]")
        good = (F.size(ends) == 2) & F.element_at(ends, 1).isNotNull() & F.try_element_at(ends, F.lit(2)).isNotNull()
        good = good & (F.try_element_at(ends, F.lit(2)) >= F.element_at(ends, 1))
        none = F.array().cast("array<int>")
        commas = F.transform(F.split(x, ","), lambda e: strip(e).try_cast("int"))
        return F.when(ranged & good, F.sequence(F.element_at(ends, 1), F.try_element_at(ends, F.lit(2)))).when(ranged, none).otherwise(commas)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(inside, numbers))))


def author_date_citations(text: Column) -> Column:
    """"Author, year" candidates in brackets; figures, tables and the like are left out."""
    pattern = r"\(([A-Za-z\s.,]+?)\s*,?\s*((?:19|20)\d{2})\)"
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("a"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("y"))
    own = F.filter(found, lambda x: ~F.lower(x["a"]).rlike("|".join(NOT_AUTHORS)))
    return F.transform(own, lambda x: F.concat_ws(", ", strip(x["a"]), x["y"]))


def short_cite(authors: Column, year: Column, number: Column) -> Column:
    """Surname of the first author and year, else the number in brackets."""
    first = strip(F.element_at(F.split(authors, ","), 1))
    return F.when(F.coalesce(authors, F.lit("")) == "", F.concat(F.lit("["), number.cast("string"), F.lit("]"))).when(year.isNotNull(), F.concat_ws(" ", first, F.concat(F.lit("("), year.cast("string"), F.lit(")")))).otherwise(first)
