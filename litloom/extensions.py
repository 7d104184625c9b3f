"""Extension points: strategies of resolution, providers, exporters, sources of PDFs, translators.

Each is a function with a fixed shape, registered by name; the built-in ones are registered here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litloom import dsl
from litloom.errors import ConfigurationError
from litloom.operators import dedup
from litloom.sinks import exports
from litloom.sources import normalize, providers


@dataclass
class Registry:
    """Named functions of one kind."""

    kind: str
    known: dict[str, Callable] = field(default_factory=dict)

    def add(self, name: str, f: Callable | None = None):
        """Registers f, or the function that it decorates."""
        if f is None:
            return lambda g: self.add(name, g)
        if not callable(f):
            raise ConfigurationError(f"{self.kind} {name!r} is no function")
        self.known[name.lower()] = f
        return f

    def get(self, name: str) -> Callable:
        if name.lower() not in self.known:
            raise ConfigurationError(f"unknown {self.kind} {name!r}; known: {', '.join(sorted(self.known))}")
        return self.known[name.lower()]


#: docs -> edges (a, b).
STRATEGIES = Registry("strategy")
#: raw responses -> records.
PROVIDERS = Registry("provider", dict(normalize.NORMALIZERS))
#: docs -> rows with entry, or flat rows.
EXPORTERS = Registry("exporter", dict(exports.RENDERERS))
#: docs -> docs with pdf_url and pdf_source.
PDF_SOURCES = Registry("source of PDFs", {"links": providers.pdf_candidates})
#: (text, filters) -> what a provider takes.
TRANSLATORS = Registry("translator", {"simple": dsl.to_simple, "structured": dsl.to_structured})
for _name in dsl.PROVIDER_FIELDS:
    TRANSLATORS.add(_name, lambda text, _p=_name, **filters: {"q": dsl.to_provider(_p, text), **dsl.common_filters(**filters)})


@STRATEGIES.add("exact")
def exact(docs: DataFrame) -> DataFrame:
    return dedup.exact_edges(dedup.prepared(docs)).select("a", "b")


@STRATEGIES.add("fuzzy")
def fuzzy(docs: DataFrame) -> DataFrame:
    return dedup.fuzzy_edges(dedup.prepared(docs)).select("a", "b")


@STRATEGIES.add("semantic")
def semantic(docs: DataFrame) -> DataFrame:
    return dedup.semantic_edges(docs.select("idx", "embedding"))


def resolve(docs: DataFrame, *names: str) -> DataFrame:
    """docs with cluster_id by the edges of the named strategies."""
    edges = [STRATEGIES.get(n)(docs).select("a", "b") for n in names] or [docs.select(F.col("idx").alias("a"), F.col("idx").alias("b")).limit(0)]
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return dedup.clusters(docs, out)


def pdf_chain(docs: DataFrame, *names: str) -> DataFrame:
    """The first source that has an address wins."""
    out = docs.withColumns({"pdf_url": F.lit(None).cast("string"), "pdf_source": F.lit(None).cast("string")})
    for n in names:
        tried = PDF_SOURCES.get(n)(out.drop("pdf_url", "pdf_source")).select("idx", F.col("pdf_url").alias("__url"), F.col("pdf_source").alias("__source"))
        out = out.join(tried, "idx", "left")
        out = out.withColumns({"pdf_source": F.when(F.col("pdf_url").isNotNull(), F.col("pdf_source")).otherwise(F.col("__source")), "pdf_url": F.coalesce("pdf_url", "__url")}).drop("__url", "__source")
    return out
