"""Quality, heuristic and export filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litloom.functions.text import joined, textify, truthy

#: Rows of the queries dimension that are broadcast; more are joined by shuffle.
MOST_QUERIES = 100_000


def quality_filter(docs: DataFrame, queries: DataFrame, exempt_provider: bool = False) -> DataFrame:
    """Drops a document with any word its query excludes, or none that it asks for.

    queries: query_id, include_any, exclude_any (arrays).  Unknown queries and empty lists
    let everything pass.  exempt_provider: an excluded word that names the provider is ignored.
    """
    small = queries.limit(MOST_QUERIES + 1).count() <= MOST_QUERIES
    asked = queries.select(F.col("query_id").alias("__q"), F.col("include_any").alias("__in"), F.col("exclude_any").alias("__out"))
    out = docs.join(F.broadcast(asked) if small else asked, F.col("query_id") == F.col("__q"), "left")
    text = F.lower(joined(F.col("title"), F.col("abstract"), F.col("venue")))
    banned = lambda w: F.contains(text, F.lower(w)) & (~(F.lower(w) == F.lower("provider")) if exempt_provider else F.lit(True))
    none = F.array().cast("array<string>")
    wanted, refused = F.coalesce("__in", none), F.coalesce("__out", none)
    keep = ~F.exists(refused, banned) & ((F.size(wanted) == 0) | F.exists(wanted, lambda w: F.contains(text, F.lower(w))))
    return out.where(keep).drop("__q", "__in", "__out")


def _any(text: Column, patterns: list[str]) -> Column:
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def heuristic_filter(docs: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, groups: list[list[str]] | None = None) -> DataFrame:
    """Every group must match (any of its patterns); without groups, any include pattern; and no exclude pattern."""
    text = textify(F.col("title"), F.col("abstract"))
    groups = groups or ([include] if include else [])
    keep = reduce(Column.__and__, [_any(text, g) for g in groups], F.lit(True))
    return docs.where(keep & ~_any(text, exclude or []))


def heuristic_reasons(docs: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, groups: list[list[str]] | None = None) -> DataFrame:
    """docs with decision and reason: the first exclude pattern that matches, else the first group that fails (from 1)."""
    text = textify(F.col("title"), F.col("abstract"))
    reason = F.lit(None).cast("string")
    if groups:
        for n, g in reversed(list(enumerate(groups, 1))):
            reason = F.when(~_any(text, g), F.lit(f"Failed include group {n}")).otherwise(reason)
    elif include:
        reason = F.when(~_any(text, include), F.lit("Failed all heuristic include patterns")).otherwise(reason)
    for p in reversed(exclude or []):
        reason = F.when(_any(text, [p]), F.lit(f"Matched exclude pattern: {p}")).otherwise(reason)
    out = docs.withColumn("reason", reason)
    return out.withColumn("decision", F.when(F.col("reason").isNull(), "pass").otherwise("exclude"))


def export_filter(docs: DataFrame, min_year: int | None = None, max_year: int | None = None, has_doi: bool = False, has_abstract: bool = False) -> DataFrame:
    """A bound on the year drops records without one."""
    out = docs
    if min_year is not None:
        out = out.where(F.col("year") >= min_year)
    if max_year is not None:
        out = out.where(F.col("year") <= max_year)
    if has_doi:
        out = out.where(truthy(F.col("doi")))
    if has_abstract:
        out = out.where(truthy(F.col("abstract")))
    return out


def max_results(docs: DataFrame, n: int, keys: tuple[str, ...] = ("provider", "query_id"), order: str = "idx") -> DataFrame:
    """The first n of each group; Spark keeps n rows a group in each task before it shuffles."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return docs.withColumn("__n", rank).where(F.col("__n") <= n).drop("__n")


def first_by_key(docs: DataFrame, key: str, order: str = "idx") -> DataFrame:
    """One row for each key, the first; rows without a key all stay."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    named = docs.where(F.col(key).isNotNull()).withColumn("__n", rank).where("__n = 1").drop("__n")
    return named.unionByName(docs.where(F.col(key).isNull()))


def decided(docs: DataFrame, *decisions: str) -> DataFrame:
    """Records with one of the decisions of a screening: include and maybe for ranking, include alone for what costs more."""
    return docs.where(F.col("decision").isin(*(decisions or ("include",))))
