"""Readers of record files, query files and run directories."""

from __future__ import annotations

import json
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litloom.errors import ConfigurationError, ValidationError
from litloom.schema import CHUNK, DOCUMENT, REFERENCE


def jsonl(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): rows that do not parse, or lack a title, are kept apart with their text."""
    with_bad = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    raw = spark.read.schema(with_bad).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    ok = F.col("_corrupt_record").isNull()
    if "title" in schema.names:
        ok = ok & (F.coalesce(F.col("title"), F.lit("")) != "")
    return raw.where(ok).drop("_corrupt_record"), raw.where(~ok)


def runs(spark: SparkSession, directory: str) -> DataFrame:
    """UNION ALL of the all_results.jsonl of a run's provider folders; folders of de-duplication are left out."""
    read = spark.read.schema(DOCUMENT).json(f"{directory}/*/all_results.jsonl")
    name = F.element_at(F.split(F.input_file_name(), "/"), -2)
    return read.withColumn("__from", name).where(~F.contains(F.lower("__from"), F.lit("dedup"))).drop("__from")


def csv(spark: SparkSession, path: str) -> DataFrame:
    """The flat export read back; authors become structs again."""
    from litloom.functions.people import split_last_space
    from litloom.sinks.exports import CSV_COLUMNS

    schema = T.StructType([T.StructField(c, T.StringType()) for c in CSV_COLUMNS])
    raw = spark.read.schema(schema).csv(path, header=True, escape='"', multiLine=True)
    out = raw.select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in CSV_COLUMNS])
    names = F.filter(F.split(F.coalesce("authors", F.lit("")), "; "), lambda x: x != "")
    return out.withColumns({"authors": F.transform(names, split_last_space), "year": F.col("year").try_cast("int"), "cited_by_count": F.col("cited_by_count").try_cast("int"), "cluster_id": F.col("cluster_id").try_cast("int")})


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK).json(path, multiLine=True)


def references(spark: SparkSession, path: str) -> DataFrame:
    """A library file is an object from number to entry."""
    raw = spark.read.schema(T.StructType([T.StructField("references", T.MapType(T.StringType(), REFERENCE)), T.StructField("source_file", T.StringType())])).json(path, multiLine=True)
    return raw.select("source_file", F.explode("references").alias("key", "r")).select("source_file", F.coalesce("r.number", F.col("key").try_cast("int")).alias("number"), "r.raw_text", "r.authors", "r.title", "r.year", "r.venue", "r.doi")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """source_file, page_number, text of Markdown files, one page each."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"), F.lit(1).alias("page_number"), F.col("value").alias("text"))


def pdfs(spark: SparkSession, path: str, parser) -> DataFrame:
    """source_file, page_number, text by a pluggable parser: bytes -> list of page texts.  Files without the PDF mark give no page."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    good = raw.where(F.substring("content", 1, 4) == F.lit(b"%PDF")).select(F.element_at(F.split("path", "/"), -1).alias("source_file"), "content")

    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows = [(f, n, t) for f, c in zip(pdf["source_file"], pdf["content"]) for n, t in enumerate(parser(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=["source_file", "page_number", "text"])

    return good.mapInPandas(run, "source_file string, page_number int, text string")


def flatten_queries(spec: dict | list) -> list[dict]:
    """Query file contents as rows: the listed form, or {category: [texts]}."""
    rows: list[dict] = []
    listed = spec.get("queries") if isinstance(spec, dict) else spec
    if isinstance(listed, list):
        for n, q in enumerate(listed, 1):
            q = {"text": q} if isinstance(q, str) else q
            rows.append({"query_id": str(q.get("id") or f"Q{n:02d}"), "text": q.get("query") or q.get("text") or "", "category": q.get("theme") or q.get("category") or "general", "include_any": list(q.get("include_any") or []), "exclude_any": list(q.get("exclude_any") or [])})
    elif isinstance(spec, dict):
        for category, texts in spec.items():
            if isinstance(texts, list):
                rows += [{"query_id": f"Q{len(rows) + 1 + k:02d}", "text": t, "category": category, "include_any": [], "exclude_any": []} for k, t in enumerate(texts)]
    if not rows:
        raise ConfigurationError("no queries found")
    return rows


def queries(spark: SparkSession, text: str, form: str = "json") -> DataFrame:
    """The queries dimension from the text of a JSON or YAML file; it is small and made on the driver."""
    if form == "yaml":
        try:
            import yaml
        except ImportError as e:
            raise ConfigurationError("reading YAML needs the yaml module") from e
        spec = yaml.safe_load(text)
    else:
        spec = json.loads(text)
    return spark.createDataFrame(flatten_queries(spec), "query_id string, text string, category string, include_any array<string>, exclude_any array<string>")


def latest_run(names: list[str], prefix: str = "run_") -> str:
    """Names carry their time, so the greatest is the latest."""
    own = [posixpath.basename(n.rstrip("/")) for n in names]
    own = [n for n in own if n.startswith(prefix)]
    if not own:
        raise ValidationError(f"no run named {prefix}*")
    return max(own)
