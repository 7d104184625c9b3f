"""Years and dates from loose text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "dd/MM/yyyy")


def extract_year(c: Column) -> Column:
    """A whole number from 1900 to 2100, else the first such word of the text."""
    whole = c.try_cast("int")
    found = F.nullif(F.regexp_extract(c, r"\b(19|20)\d{2}\b", 0), F.lit("")).try_cast("int")
    return F.when(whole.between(1900, 2100), whole).otherwise(F.when(whole.isNull(), found))


def medline_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\d{4}", 0), F.lit("")).try_cast("int")


def parse_date(c: Column) -> Column:
    """The first of FORMATS that fits."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in FORMATS])


def in_years(year: Column, low: int | None, high: int | None) -> Column:
    """Missing years pass."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (year >= low)
    if high is not None:
        ok = ok & (year <= high)
    return year.isNull() | (year == 0) | ok
