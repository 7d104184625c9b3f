"""Boolean query language: tokens, provider strings, and predicates over documents.

Grammar of the predicate: OR of ANDs of (possibly negated) units; terms that stand side by
side are ANDed; a unit is a term, a phrase or a bracket, each with an optional `field:`
that holds for the whole bracket.  A term matches where the field contains it, whatever
the case; `year` compares numbers.  Without a field, title, abstract and venue are searched.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from litloom.errors import QueryError
from litloom.functions.text import joined, plain_quotes

FIELDS = ("title", "abstract", "full_text", "author", "year", "venue", "doi", "keyword", "any")
OPERATORS = ("AND", "OR", "NOT")
_LEX = re.compile(r'\s*(?:(?P<paren>[()])|(?P<field>\w+):|"(?P<phrase>[^"]*)"|(?P<op>(?:AND|OR|NOT)\b)|(?P<word>[^\s()]+))', re.I)

#: The names that providers give the fields.
PROVIDER_FIELDS = {
    "openalex": {"title": "title", "abstract": "abstract", "author": "authorships.author.display_name", "venue": "primary_location.source.display_name", "year": "publication_year", "doi": "doi"},
    "crossref": {"title": "title", "abstract": "abstract", "author": "author", "venue": "container-title", "year": "issued", "doi": "DOI"},
    "arxiv": {"title": "ti", "abstract": "abs", "author": "au", "venue": "jr", "any": "all"},
    "pubmed": {"title": "Title", "abstract": "Abstract", "author": "Author", "venue": "Journal", "year": "Date - Publication", "doi": "DOI"},
    "doaj": {"title": "bibjson.title", "abstract": "bibjson.abstract", "author": "bibjson.author.name", "venue": "bibjson.journal.title", "year": "bibjson.year", "doi": "bibjson.doi"},
    "core": {"title": "title", "abstract": "abstract", "author": "authors.name", "venue": "publisher", "year": "yearPublished", "doi": "doi"},
    "ieee": {"title": "article_title", "abstract": "abstract", "author": "author", "venue": "publication_title", "year": "publication_year", "doi": "doi"},
    "s2": {},
}


@dataclass(frozen=True)
class Token:
    value: str
    field: str | None = None
    is_phrase: bool = False
    is_operator: bool = False


def tokenize(text: str | None) -> list[Token]:
    """Tokens in order; a field belongs to the next term, an unknown one counts as `any`."""
    out, field = [], None
    for m in _LEX.finditer(plain_quotes(text or "").strip()):
        kind = m.lastgroup
        if kind == "field":
            name = m["field"].lower()
            field = name if name in FIELDS else "any"
        elif kind in ("paren", "op"):
            out.append(Token(m[kind].upper(), is_operator=True))
        else:
            out.append(Token(m[kind], field, is_phrase=kind == "phrase"))
            field = None
    return out


def is_valid(tokens: list[Token]) -> bool:
    """Something there, and brackets that close what they open."""
    depth = 0
    for t in tokens:
        depth += {"(": 1, ")": -1}.get(t.value, 0) if t.is_operator else 0
        if depth < 0:
            return False
    return bool(tokens) and depth == 0


# -- provider strings ------------------------------------------------------------------


def _term(provider: str, token: Token) -> str:
    names = PROVIDER_FIELDS[provider]
    value = f'"{token.value}"' if token.is_phrase else token.value
    if token.field in (None, "any"):
        prefix = names.get("any") if token.field == "any" or provider == "arxiv" else None
        return f"{prefix}:{value}" if prefix else value
    name = names.get(token.field, token.field)
    return f"{value}[{name}]" if provider == "pubmed" else f"{name}:{value}"


def to_provider(provider: str, text: str, strict: bool = True) -> str:
    """The query in a provider's Boolean syntax; a malformed one is an error, or passes as it is if not strict."""
    if provider == "s2":
        return to_bulk(text)
    tokens = tokenize(text)
    if not is_valid(tokens):
        if strict:
            raise QueryError(f"malformed query: {text!r}")
        return text
    parts = [t.value if t.is_operator else _term(provider, t) for t in tokens]
    return " ".join(parts).replace("( ", "(").replace(" )", ")")


def escape_special_chars(text: str, special: str = "") -> str:
    """Each of the special characters with a backslash before it."""
    return re.sub(f"([{re.escape(special)}])", r"\\\1", text) if special else text


def translated(text: Column, provider: str) -> Column:
    """The query of each row in a provider's syntax, in Arrow batches; malformed ones pass as they are."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else to_provider(provider, x, strict=False))

    return run(text)


def to_bulk(text: str | None) -> str:
    """Signs for the operators: + for AND, | for OR, a minus before what NOT refuses."""
    text = re.sub(r"\bNOT\b\s+", "-", text or "", flags=re.I)
    for word, sign in (("AND", "+"), ("OR", "|")):
        text = re.sub(rf"\b{word}\b", sign, text, flags=re.I)
    return " ".join(text.split())


def to_simple(text: str, **filters) -> dict:
    return {"q": text, **common_filters(**filters)}


def by_field(tokens: list[Token]) -> dict[str, list[str]]:
    """Terms grouped by field, operators ignored."""
    out: dict[str, list[str]] = {}
    for t in tokens:
        if not t.is_operator:
            out.setdefault(t.field or "any", []).append(t.value)
    return out


def to_structured(text: str, names: dict[str, str] | None = None, **filters) -> dict:
    names = names or {}
    out: dict = {names.get(f, f): v[0] if len(v) == 1 else {"$or": v} for f, v in by_field(tokenize(text)).items()}
    extra = common_filters(**filters)
    return out | ({"filters": extra} if extra else {})


def common_filters(year_min: int | None = None, year_max: int | None = None, language: str | None = None) -> dict:
    return {k: v for k, v in (("year_min", year_min), ("year_max", year_max), ("language", language)) if v}


def provider_params(provider: str, text: str, year_min: int | None = None, year_max: int | None = None, language: str | None = None) -> dict:
    """Request parameters of a search, without keys or addresses."""
    q = to_provider(provider, text, strict=False)
    span = f"{year_min or ''}-{year_max or ''}" if year_min or year_max else None
    if provider == "openalex":
        years = [f"publication_year:{year_min}" if year_min == year_max and year_min else None]
        if years == [None]:
            years = [f"publication_year:>{year_min - 1}" if year_min else None, f"publication_year:<{year_max + 1}" if year_max else None]
        parts = [*filter(None, years), f"language:{language}" if language else None, "type:article"]
        return {"search": q, "filter": ",".join(filter(None, parts))}
    if provider == "crossref":
        parts = [f"from-pub-date:{year_min}" if year_min else None, f"until-pub-date:{year_max}" if year_max else None]
        return {"query": q, "filter": ",".join(filter(None, parts))}
    if provider == "arxiv":
        return {"search_query": q, "sortBy": "submittedDate", "sortOrder": "descending"}
    if provider == "s2":
        return {"query": q} | ({"year": span} if span else {})
    if provider == "pubmed":
        dates = f' AND ("{year_min or 1900}"[Date - Publication] : "{year_max or 3000}"[Date - Publication])' if span else ""
        return {"term": f"({q}){dates}" if dates else q}
    if provider == "doaj":
        return {"q": f"({q}) AND bibjson.year:[{year_min or '*'} TO {year_max or '*'}]" if span else q}
    if provider == "ieee":
        return {"querytext": q} | ({"start_year": year_min} if year_min else {}) | ({"end_year": year_max} if year_max else {})
    return {"q": f"({q}) AND yearPublished>={year_min or 0} AND yearPublished<={year_max or 9999}" if span else q}


# -- predicates ------------------------------------------------------------------------

#: Column of each field over the flat document view; a missing column never matches.
DEFAULT_COLUMNS = {"title": "title", "abstract": "abstract", "full_text": "abstract", "author": "author_names", "venue": "venue", "doi": "doi", "keyword": "title", "year": "year"}


def _column(field: str | None, columns: dict[str, str]) -> Column:
    if field in (None, "any"):
        return joined(*[F.col(columns[f]) for f in ("title", "abstract", "venue") if f in columns])
    return F.coalesce(F.col(columns[field]).cast("string"), F.lit("")) if field in columns else F.lit("")


def _match(token: Token, scope: str | None, columns: dict[str, str]) -> Column:
    field = token.field or scope
    if field == "year":
        if "year" not in columns or not token.value.strip().isdigit():
            return F.lit(False)
        return F.coalesce(F.col(columns["year"]) == int(token.value), F.lit(False))
    return F.contains(F.lower(_column(field, columns)), F.lit(token.value.lower()))


class _Parser:
    def __init__(self, text: str, columns: dict[str, str]):
        self.items = [m for m in _LEX.finditer(plain_quotes(text).strip())]
        self.at, self.columns = 0, columns

    def _kind(self) -> str | None:
        if self.at >= len(self.items):
            return None
        m = self.items[self.at]
        return m["paren"] or (m["op"] or "").upper() or m.lastgroup

    def either(self, scope: str | None) -> Column:
        parts = [self.all_of(scope)]
        while self._kind() == "OR":
            self.at += 1
            parts.append(self.all_of(scope))
        return reduce(Column.__or__, parts)

    def all_of(self, scope: str | None) -> Column:
        parts = [self.unit(scope)]
        while self._kind() not in (None, "OR", ")"):
            self.at += self._kind() == "AND"
            parts.append(self.unit(scope))
        return reduce(Column.__and__, parts)

    def unit(self, scope: str | None) -> Column:
        kind = self._kind()
        if kind == "NOT":
            self.at += 1
            return ~self.unit(scope)
        if kind == "field":
            name = self.items[self.at]["field"].lower()
            self.at += 1
            return self.unit(name if name in FIELDS else "any")
        if kind == "(":
            self.at += 1
            inside = self.either(scope)
            if self._kind() != ")":
                raise QueryError("a bracket is not closed")
            self.at += 1
            return inside
        if kind not in ("word", "phrase"):
            raise QueryError(f"a term is missing before {kind or 'the end'}")
        m = self.items[self.at]
        self.at += 1
        return _match(Token(m[kind], is_phrase=kind == "phrase"), scope, self.columns)


def to_column(text: str, columns: dict[str, str] | None = None) -> Column:
    """The query as a predicate."""
    if not is_valid(tokenize(text)):
        raise QueryError(f"malformed query: {text!r}")
    parser = _Parser(text, DEFAULT_COLUMNS if columns is None else columns)
    out = parser.either(None)
    if parser.at != len(parser.items):
        raise QueryError(f"unexpected {parser._kind()}")
    return out
