"""Profiles and statistics of corpora and of extracted facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litloom.functions.numbers import classify_json
from litloom.functions.text import normalize_value, strip, truthy
from litloom.operators.ranges import running_before


def validation_profile(docs: DataFrame) -> DataFrame:
    """One row of completeness counts and year bounds, in one pass."""
    has = {f"with_{c}": F.count_if(truthy(F.col(c))) for c in ("doi", "abstract", "arxiv_id", "venue", "url") if c in docs.columns}
    odd = F.count_if(truthy(F.col("doi")) & ~F.startswith(F.col("doi"), F.lit("10.")))
    return docs.agg(
        F.count("*").alias("total"), *[v.alias(k) for k, v in has.items()], F.count_if(F.size("authors") > 0).alias("with_authors"), F.count_if(~truthy(F.col("title"))).alias("missing_title"),
        F.count_if(F.coalesce("year", F.lit(0)) == 0).alias("missing_year"), odd.alias("invalid_doi"), F.min("year").alias("min_year"), F.max("year").alias("max_year"),
    )


def duplicate_titles(docs: DataFrame) -> DataFrame:
    return docs.where(truthy(F.col("title"))).groupBy(F.lower(strip(F.col("title"))).alias("title")).agg(F.count("*").alias("records")).where("records > 1")


def distribution(docs: DataFrame, column: str, width: int = 40) -> DataFrame:
    """Counts with share and bar width; the totals are joined as one row, so no window gathers the counts."""
    counts = docs.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("records"))
    totals = counts.agg(F.sum("records").alias("all"), F.max("records").alias("most"))
    out = counts.crossJoin(F.broadcast(totals))  # one row
    return out.select(column, "records", (F.col("records") * 100 / F.col("all")).alias("percent"), F.floor(F.col("records") * width / F.col("most")).cast("long").alias("bar"))


def with_total(docs: DataFrame, column: str) -> DataFrame:
    """Counts and, by ROLLUP, the row of the total."""
    return docs.rollup(column).agg(F.count("*").alias("records"), F.grouping(column).cast("long").alias("is_total"))


def top_values(values: DataFrame, column: str, k: int) -> DataFrame:
    """The k commonest; ties by value."""
    return values.groupBy(column).agg(F.count("*").alias("records")).orderBy(F.desc("records"), column).limit(k)


def top_by(values: DataFrame, dimension: str, column: str, k: int) -> DataFrame:
    counts = values.groupBy(dimension, column).agg(F.count("*").alias("records"))
    rank = F.row_number().over(Window.partitionBy(dimension).orderBy(F.desc("records"), column))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def split_values(c: Column, sep: str = ",") -> Column:
    """Distinct-cased items of a joined list, blanks left out."""
    return F.filter(F.transform(F.split(c, sep), normalize_value), lambda x: x != "")


def numeric_summary(values: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return values.where(c.isNotNull()).agg(
        F.count("*").alias("n"), F.min(c).alias("low"), F.max(c).alias("high"), F.avg(c).alias("mean"), F.percentile(c, 0.5).alias("median"), F.stddev_samp(c).alias("stdev"),
        F.count_if(c <= 1).alias("lte_1"), F.count_if((c > 1) & (c <= 100)).alias("gt_1_le_100"), F.count_if(c > 100).alias("gt_100"),
    )


def pearson(values: DataFrame, x: str, y: str, least: int = 3) -> DataFrame:
    both = values.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.agg(F.count("*").alias("n"), F.corr(x, y).alias("r")).select("n", F.when(F.col("n") >= least, F.col("r")).alias("r"))


def average_ranks(values: DataFrame, column: str, name: str) -> DataFrame:
    """Ranks with ties averaged: counts of each value, a running sum over ranges of the distinct values."""
    counts = values.groupBy(column).agg(F.count("*").alias("__c"))
    ranks = running_before(counts, column, F.col("__c"), "__before").select(F.col(column).alias("__v"), (F.col("__before") + (F.col("__c") + 1) / 2).alias(name))
    return values.join(ranks, F.col(column) == F.col("__v")).drop("__v")


def spearman(values: DataFrame, x: str, y: str, least: int = 3) -> DataFrame:
    both = values.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    return pearson(average_ranks(average_ranks(both, x, "rx"), y, "ry"), "rx", "ry", least)


def field_coverage(facts: DataFrame, fields: list[str]) -> DataFrame:
    """Counts of value, nr, empty_list, empty_object and missing for each JSON-valued field."""
    long = facts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), classify_json(F.col(f)).alias("class")) for f in fields])).alias("x")).select("x.*")
    classes = ("value", "nr", "empty_list", "empty_object", "missing")
    return long.groupBy("field").agg(*[F.count_if(F.col("class") == c).alias(c) for c in classes])


def prisma_counts(before: DataFrame, filtered: DataFrame, clustered: DataFrame) -> DataFrame:
    """Flow of records: identified, after the filters, unique, removed."""
    total = before.agg(F.count("*").alias("identified"))
    kept = filtered.agg(F.count("*").alias("after_filter"))
    sizes = clustered.groupBy("cluster_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("unique_documents"), F.count_if(F.col("n") == 1).alias("singleton_clusters"))
    out = total.crossJoin(kept).crossJoin(sizes)  # three single rows
    return out.withColumn("duplicates_removed", F.col("after_filter") - F.col("unique_documents"))


def prisma_by_provider(before: DataFrame, clustered: DataFrame) -> DataFrame:
    """Of each provider: records identified, left by the filters, and first of their cluster."""
    total = before.groupBy("provider").agg(F.count("*").alias("identified"))
    kept = clustered.groupBy("provider").agg(F.count("*").alias("after_filter"), F.count_if(F.col("idx") == F.col("label")).alias("unique_documents"))
    return total.join(kept, "provider", "left").na.fill(0, ["after_filter", "unique_documents"])
