"""Search runs: what to ask, what is there already, what came back, and the files of a run.

A run is a folder.  Its results lie under results/provider=.../query_id=..., so a run that is
taken up again finds what is there by reading the partitions, and writing one query's results
anew replaces that partition alone.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litloom import dsl
from litloom.errors import ProviderNotFoundError
from litloom.functions.text import truthy
from litloom.sources.providers import RATES

#: Most results of a search that a provider gives, whatever is asked for.
CAPS = {"arxiv": 10_000, "crossref": 50_000}
#: How results are ordered by the providers that sort them.
ORDERS = {"arxiv": ("published", False), "ieee": ("year", False)}


def selected(queries: DataFrame, query_id: str | None = None, providers: list[str] | None = None, include: list[str] | None = None, skip: list[str] | None = None) -> DataFrame:
    """The plan: one row for each query and provider; only the included providers, without the skipped."""
    known = list(providers or RATES)
    for p in [*(include or []), *(skip or [])]:
        if p not in known:
            raise ProviderNotFoundError(f"unknown provider {p!r}")
    wanted = [p for p in known if (not include or p in include) and p not in (skip or [])]
    rows = queries if query_id is None else queries.where(F.col("query_id") == query_id)
    return rows.withColumn("provider", F.explode(F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<string>")))


def categories(queries: DataFrame) -> DataFrame:
    return queries.agg(F.countDistinct("category").alias("categories"))


def with_translations(plan: DataFrame) -> DataFrame:
    """The plan with translated_query, each text in its provider's syntax; queries are a small dimension, translated on the driver."""
    texts = plan.select("text", "provider").distinct().collect()
    rows = [(r["text"], r["provider"], dsl.to_provider(r["provider"], r["text"], strict=False)) for r in texts]
    known = plan.sparkSession.createDataFrame(rows, "text string, provider string, translated_query string")
    return plan.join(known, ["text", "provider"], "left")


def resumed(plan: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to search, kept): plan rows without any result yet, and the results of the others."""
    keys = ["provider", "query_id"]
    there = results.select(*keys).distinct()
    return plan.join(there, keys, "left_anti"), results.join(plan.select(*keys).distinct(), keys, "left_semi")


def collected(records: DataFrame, most: int | None = None, order: str = "idx") -> DataFrame:
    """Records of a search: of one provider, query and identifier the first, and of each query the first `most`.

    A record's identifier is its provider's, else its DOI, else its title.  Providers that cap
    or sort their results do so here as well.
    """
    name = F.coalesce(*[F.when(truthy(F.col(c)), F.concat(F.lit(f"{c}:"), F.lower(c))) for c in ("provider_id", "doi", "title")])
    keys = ["provider", "query_id"]
    first = F.row_number().over(Window.partitionBy(*keys, "__name").orderBy(order))
    rows = records.withColumn("__name", name).withColumn("__first", first).where("__first = 1 or __name is null").drop("__name", "__first")
    rank = [F.when(F.col("provider") == p, F.col(c) if up else -F.col(c)) for p, (c, up) in ORDERS.items() if c in records.columns and records.schema[c].dataType.typeName() in ("integer", "long")]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[r.asc_nulls_last() for r in rank], order))
    cap = F.coalesce(*[F.when(F.col("provider") == p, F.lit(n)) for p, n in CAPS.items()], F.lit(2**31 - 1))
    return rows.withColumn("__place", place).where(F.col("__place") <= F.least(cap, F.lit(most if most is not None else 2**31 - 1))).drop("__place")


def run_counts(plan: DataFrame, results: DataFrame) -> DataFrame:
    """Records of each query and provider of the plan, 0 where none came."""
    found = results.groupBy("provider", "query_id").agg(F.count("*").alias("records"))
    return plan.select("provider", "query_id").distinct().join(found, ["provider", "query_id"], "left").withColumn("records", F.coalesce("records", F.lit(0).cast("long")))


def summary_lines(counts: DataFrame) -> DataFrame:
    """(ord, line) of a run's summary: the records of each provider, most first, and of all."""
    per = counts.groupBy("provider").agg(F.sum("records").alias("n"))
    line = lambda name: F.concat(name, F.lit(": "), F.format_number("n", 0), F.lit(" documents"))
    each = per.select(F.row_number().over(Window.orderBy(F.desc("n"), "provider")).cast("long").alias("ord"), F.concat(F.lit("  "), line(F.col("provider"))).alias("line"))  # a row for each provider
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(2**31).alias("ord"), line(F.lit("Total")).alias("line"))
    return each.unionByName(total)


def write_results(results: DataFrame, folder: str) -> None:
    """Results by provider and query; partitions that come again are replaced, the others stay."""
    out = results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("provider", "query_id").json(f"{folder}/results")


def read_results(spark: SparkSession, folder: str, schema=None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "false")
    return (reader.schema(schema) if schema is not None else reader).json(f"{folder}/results")


def write_metadata(spark: SparkSession, folder: str, **values) -> None:
    """One JSON object."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/metadata")


def write_run(plan: DataFrame, results: DataFrame, folder: str, run_id: str, formats: tuple[str, ...] = ("jsonl",), **settings) -> None:
    """A run's files: results by query, all results of each provider, metadata with the translated queries, summary."""
    from litloom.sinks import exports

    spark = results.sparkSession
    write_results(results, folder)
    for kind in formats:
        rows = exports.RENDERERS[exports.check_format(kind)](results)
        if kind == "csv":
            rows.write.mode("overwrite").partitionBy("provider").csv(f"{folder}/all_results_csv", header=True, escape='"')
        else:
            results.select("provider", F.to_json(F.struct(*results.columns)).alias("value")).write.mode("overwrite").partitionBy("provider").text(f"{folder}/all_results_{kind}")
    counts = run_counts(plan, results)
    asked = with_translations(plan).select("provider", "query_id", "text", "translated_query")
    details = [r.asDict() for r in asked.join(counts, ["provider", "query_id"]).orderBy("query_id", "provider").collect()]  # the plan is small
    totals: dict[str, int] = {}
    for r in details:
        totals[r["provider"]] = totals.get(r["provider"], 0) + r["records"]
    write_metadata(spark, folder, run_id=run_id, query_details=details, results=totals, config=settings)
    summary_lines(counts).coalesce(1).sortWithinPartitions("ord").select(F.col("line").alias("value")).write.mode("overwrite").text(f"{folder}/summary")


def write_dedup(clustered: DataFrame, folder: str) -> None:
    """Files of a de-duplication: clusters, representatives as JSON lines and CSV, mapping, statistics."""
    from litloom.operators import dedup
    from litloom.sinks import exports

    exports.write(clustered, f"{folder}/clusters", "jsonl", mode="clusters")
    exports.write(clustered, f"{folder}/representatives", "jsonl", mode="representatives")
    exports.write(clustered, f"{folder}/representatives_csv", "csv", mode="representatives")
    exports.cluster_mapping(clustered).write.json(f"{folder}/cluster_mapping")
    dedup.statistics(clustered).coalesce(1).write.json(f"{folder}/statistics")
