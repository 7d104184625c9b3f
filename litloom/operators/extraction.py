"""Extraction of facts from papers with a pluggable backend, merging of results, and what is reported of them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litloom.functions.numbers import extract_accuracy
from litloom.functions.text import truthy
from litloom.operators.stats import split_values

CONTEXT_LIMIT = 50_000
#: "- ", ": " and the line break.
LEAST_LINE = 5


class Extractor(Protocol):
    """Facts of one prompt: {paper id: {field: JSON text}}."""

    def extract(self, group: str, prompt: str, papers: list[str]) -> dict[str, dict[str, str]]: ...


def screening_prompts(docs: DataFrame) -> DataFrame:
    """Prompt for each included record; a missing abstract reads NR."""
    part = lambda c: F.when(truthy(F.col(c)), F.col(c)).otherwise("NR")
    prompt = F.concat(F.lit("Title: "), part("title"), F.lit("\nAbstract: "), part("abstract"))
    return docs.where("decision = 'include'").withColumn("prompt", prompt)


def batch_prompts(selected: DataFrame) -> DataFrame:
    """One prompt for each group and batch: the papers' excerpts in order; group_id, batch, paper_id, ord, text."""
    excerpt = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n\n")
    papers = selected.groupBy("group_id", "batch", "paper_id").agg(excerpt.alias("text"))
    entry = F.struct("paper_id", F.concat(F.lit("## Paper "), F.col("paper_id"), F.lit("\n"), F.col("text")).alias("t"))
    out = papers.groupBy("group_id", "batch").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return out.select("group_id", "batch", F.transform("e", lambda x: x["paper_id"]).alias("papers"), F.array_join(F.transform("e", lambda x: x["t"]), "\n\n").alias("prompt"))


def extract(prompts: DataFrame, backend: Extractor) -> DataFrame:
    """paper_id, group_id, facts (map of field to JSON), error; a failing prompt gives its papers an error and no facts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for group, papers, prompt in zip(pdf["group_id"], pdf["papers"], pdf["prompt"]):
                try:
                    found, error = backend.extract(group, prompt, list(papers)), None
                except Exception as e:  # a prompt's fault, told in its rows
                    found, error = {}, str(e)
                rows += [(p, group, list(found.get(p, {}).items()), error) for p in papers]
            yield pd.DataFrame(rows, columns=["paper_id", "group_id", "facts", "error"])

    raw = prompts.select("group_id", "papers", "prompt").mapInPandas(run, "paper_id string, group_id string, facts array<struct<k:string,v:string>>, error string")
    return raw.withColumn("facts", F.map_from_entries("facts"))


def unfinished(papers: DataFrame, results: DataFrame, required: list[str]) -> DataFrame:
    """Papers that lack a result of some required group."""
    done = results.where("error is null").groupBy("paper_id").agg(F.collect_set("group_id").alias("have"))
    whole = done.where(F.size(F.array_except(F.array(*map(F.lit, required)), "have")) == 0)
    return papers.join(whole.select("paper_id"), "paper_id", "left_anti")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Facts merged by paper and field, the new ones winning."""
    both = old.select("paper_id", F.explode("facts").alias("k", "v"), F.lit(0).alias("o")).unionByName(new.select("paper_id", F.explode("facts").alias("k", "v"), F.lit(1).alias("o")))
    last = both.groupBy("paper_id", "k").agg(F.max_by("v", "o").alias("v"))
    return last.groupBy("paper_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("facts"))


def matrix(analyses: DataFrame) -> DataFrame:
    """The literature matrix: lists joined by comma and blank."""
    lists = [c for c, t in analyses.dtypes if t == "array<string>"]
    return analyses.withColumns({c: F.array_join(c, ", ") for c in lists})


def item_frequencies(matrix_rows: DataFrame, column: str, k: int) -> DataFrame:
    items = matrix_rows.select(F.explode(split_values(F.col(column))).alias("item"))
    return items.groupBy("item").agg(F.count("*").alias("records")).orderBy(F.desc("records"), "item").limit(k)


def accuracies(matrix_rows: DataFrame, least: int = 5) -> DataFrame:
    """Quartiles of the reported accuracies, if there are more than `least`."""
    v = matrix_rows.select(extract_accuracy(F.col("best_accuracy")).alias("v")).where("v is not null")
    return v.agg(F.count("*").alias("n"), *[F.percentile("v", p).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]).where(F.col("n") > least)


def synthesis_contexts(matrix_rows: DataFrame, limit: int = CONTEXT_LIMIT) -> DataFrame:
    """One text for each category: its papers' lines in order of source, cut to the limit.

    A line has LEAST_LINE characters at least, so the first limit / LEAST_LINE papers by source
    hold all that fits; they are picked in each task before they meet, and of these only the
    lines that begin within the limit are gathered.
    """
    line = F.concat(F.lit("- "), F.col("source"), F.lit(": "), F.coalesce("key_contribution", F.lit("")))
    papers = matrix_rows.groupBy("category").agg(F.count("*").alias("papers"))
    order = Window.partitionBy("category").orderBy("source", "line")
    first = matrix_rows.select("category", "source", line.alias("line")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit // LEAST_LINE)
    before = F.sum(F.char_length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fits = first.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < limit)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    texts = fits.groupBy("category").agg(F.substring(joined, 1, limit).alias("context"))
    return papers.join(texts, F.col("papers").isNotNull() & papers["category"].eqNullSafe(texts["category"])).select(papers["category"], "papers", "context")


def group_coverage(results: DataFrame) -> DataFrame:
    return results.groupBy("group_id").agg(F.countDistinct("paper_id").alias("papers"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.sum(F.coalesce(F.size("facts"), F.lit(0))).alias("facts"))


def retrieval_stats(downloads: DataFrame) -> DataFrame:
    return downloads.groupBy("status").agg(F.count("*").alias("files"))
