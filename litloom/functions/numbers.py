"""Numbers and value classes of extracted facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litloom.functions.text import normalize_value

#: Spellings of "not reported", and the pattern of a number.
NOT_REPORTED = ("nr", "n/a", "na", "none", "null", "")
NUMBER = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
TASKS = {"classification task": "classification", "object detection": "detection"}


def parse_number(c: Column) -> Column:
    """The first number in the text, commas ignored."""
    return F.nullif(F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), NUMBER, 0), F.lit("")).try_cast("double")


def classify_json(c: Column) -> Column:
    """missing, nr, empty_list, empty_object or value, of a JSON text."""
    v = F.try_parse_json(c)
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    bare = F.regexp_replace(c, r"\s", "")
    return (
        F.when(c.isNull() | v.isNull() | (kind == "VOID"), "missing")
        .when((kind == "STRING") & normalize_value(text).isin(*NOT_REPORTED), "nr")
        .when(bare == "[]", "empty_list")
        .when(bare == "{}", "empty_object")
        .otherwise("value")
    )


def share(c: Column) -> Column:
    """A percentage as a fraction: up to 1 as is, up to 100 divided, more is null."""
    return F.when(c <= 1, c).when(c <= 100, c / 100)


def extract_accuracy(c: Column) -> Column:
    v = F.nullif(F.regexp_extract(c, r"(\d{2,3}\.?\d*)%", 1), F.lit("")).try_cast("double")
    return F.when(v.between(50, 100), v)


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.char_length(c) / 4)).cast("long")


def task_type(c: Column) -> Column:
    low = normalize_value(c)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in TASKS.items() for x in kv])[low], low)
