"""Text normalisation as Column functions."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def truthy(c: Column) -> Column:
    """Neither null nor empty: how the data model tells a missing string."""
    return F.coalesce(c != "", F.lit(False))


def joined(*columns: Column, sep: str = " ") -> Column:
    """Parts with a separator, null as empty."""
    return F.concat_ws(sep, *[F.coalesce(c, F.lit("")) for c in columns])


@cache
def _letters() -> tuple[str, str, dict[str, str]]:
    """Characters that decompose to one without marks, and those; combining marks follow the former alone.  Those that decompose to several."""
    ones, marks, several = {}, [], {}
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1))):
        if unicodedata.combining(c):
            marks.append(c)
        elif not "가" <= c <= "힣" and unicodedata.decomposition(c):
            d = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
            if d != c:
                (ones if len(d) == 1 else several)[c] = d
    return "".join(ones) + "".join(marks), "".join(ones.values()), several


def without_marks(c: Column) -> Column:
    """Canonical decomposition without the combining marks, character by character, in Spark's own expressions."""
    letters, plain, several = _letters()
    out = c
    for x, d in several.items():
        out = F.replace(out, F.lit(x), F.lit(d))
    out = F.when(c.rlike("[" + "".join(several) + "]"), out).otherwise(c)
    jamo = lambda first, n: F.array(*[F.lit(chr(first + k)) for k in range(n)])
    tails = F.array(F.lit(""), *[F.lit(chr(0x11A8 + k)) for k in range(27)])
    n = lambda x: F.ascii(x) - 0xAC00
    at = lambda parts, k: F.element_at(parts, k.cast("int") + 1)
    parted = lambda x: F.concat(at(jamo(0x1100, 19), F.floor(n(x) / 588)), at(jamo(0x1161, 21), F.floor(n(x) % 588 / 28)), at(tails, n(x) % 28))
    syllables = F.array_join(F.transform(F.split(out, ""), lambda x: F.when(x.rlike("[가-힣]"), parted(x)).otherwise(x)), "")
    out = F.when(c.rlike("[가-힣]"), syllables).otherwise(out)
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(out, letters, plain)).otherwise(c)


def normalize_title(c: Column) -> Column:
    """Marks dropped, lower case, white space collapsed, then signs deleted; order as listed."""
    low = strip(collapse(F.lower(without_marks(c))))
    return strip(F.regexp_replace(low, r"(?U)[^\w\s]", ""))


def title_words(normalized: Column) -> Column:
    """Distinct words of a normalised title."""
    return F.array_distinct(F.filter(F.split(normalized, r"\s+"), lambda w: w != ""))


def normalize_value(c: Column) -> Column:
    return F.lower(strip(collapse(c)))


def textify(title: Column, abstract: Column) -> Column:
    return F.lower(joined(title, abstract))


#: LaTeX's own characters and what stands for them.
LATEX = {"\\": "\\textbackslash{}", "&": "\\&", "%": "\\%", "$": "\\$", "#": "\\#", "_": "\\_", "{": "\\{", "}": "\\}", "~": "\\textasciitilde{}", "^": "\\textasciicircum{}"}


def escape_latex(c: Column) -> Column:
    """All characters at once, so what a replacement brings in is not escaped again."""
    table = F.create_map(*[F.lit(x) for kv in LATEX.items() for x in kv])
    return F.array_join(F.transform(F.split(F.coalesce(c, F.lit("")), ""), lambda x: F.coalesce(table[x], x)), "")


def cut_with_dots(c: Column, limit: int) -> Column:
    return F.when(F.char_length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("..."))).otherwise(c)


def clean_cell(c: Column) -> Column:
    return strip(collapse(F.coalesce(c, F.lit(""))))


def plain_quotes(text: str) -> str:
    """A query text with plain hyphens and quotes."""
    return text.translate(str.maketrans({"‑": "-", "“": '"', "”": '"', "‘": "'", "’": "'"}))
