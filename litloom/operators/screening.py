"""Layered screening with a pluggable judge, resuming, and the folding of layers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litloom.functions.text import strip

LAYERS = "array<struct<layer:int,name:string,decision:string,reason:string,confidence:int>>"


class Backend(Protocol):
    """Judges one record: (decision, reason, confidence)."""

    def judge(self, layer: str, title: str, abstract: str) -> tuple[str, str, int]: ...


class RuleBackend:
    """A deterministic judge: include if the text has any of the words, exclude if any of the others, else maybe."""

    def __init__(self, include: list[str], exclude: list[str]):
        self.include, self.exclude = [w.lower() for w in include], [w.lower() for w in exclude]

    def judge(self, layer: str, title: str, abstract: str) -> tuple[str, str, int]:
        text = f"{title} {abstract}".lower()
        for words, decision in ((self.exclude, "exclude"), (self.include, "include")):
            for w in words:
                if w in text:
                    return decision, f"{layer}: {w}", 90
        return "maybe", f"{layer}: no rule", 50


def screen(docs: DataFrame, backend: Backend, layers: list[str]) -> DataFrame:
    """docs with screening_layers; a record stops at its first exclude, and a failing judge counts as maybe with confidence 0."""
    names = docs.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for title, abstract in zip(pdf["title"], pdf["abstract"]):
                mine = []
                for n, layer in enumerate(layers, 1):
                    try:
                        decision, reason, confidence = backend.judge(layer, title or "", abstract or "")
                    except Exception as e:  # a row's fault, told in its columns
                        decision, reason, confidence = "maybe", f"Error: {e}", 0
                    mine.append({"layer": n, "name": layer, "decision": decision, "reason": reason, "confidence": confidence})
                    if decision == "exclude":
                        break
                out.append(mine)
            yield pdf.assign(screening_layers=out)[[*names, "screening_layers"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", screening_layers {LAYERS}"
    return fold(docs.mapInPandas(run, schema))


def fold_layers(layers: Column) -> tuple[Column, Column, Column]:
    """decision, confidence, reason: the first exclude stops; any maybe makes maybe; least confidence; reasons joined."""
    stop = F.array_position(F.transform(layers, lambda x: x["decision"]), "exclude")
    seen = F.when(stop > 0, F.slice(layers, F.lit(1), stop.cast("int"))).otherwise(layers)
    decision = F.when(stop > 0, "exclude").when(F.exists(seen, lambda x: x["decision"] == "maybe"), "maybe").otherwise("include")
    return decision, F.array_min(F.transform(seen, lambda x: x["confidence"])), F.array_join(F.transform(seen, lambda x: x["reason"]), " | ")


def fold(docs: DataFrame) -> DataFrame:
    decision, confidence, reason = fold_layers(F.col("screening_layers"))
    return docs.withColumns({"decision": decision, "screening_confidence": confidence, "screening_reason": reason})


def unscreened(docs: DataFrame, done: DataFrame) -> DataFrame:
    """Records that neither by DOI nor by title are among the done; two anti-joins, as an OR would be a nested loop."""
    by_doi = done.where(F.col("doi").isNotNull()).select("doi").distinct()
    by_title = done.where(F.col("title").isNotNull()).select("title").distinct()
    return docs.join(by_doi, "doi", "left_anti").join(by_title, "title", "left_anti")


def last_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Of the rows of a key the last in the given order."""
    names = [c for c in rows.columns if c != key]
    out = rows.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("r"))
    return out.select(key, "r.*")


def with_recovery(original: DataFrame, recovered: DataFrame) -> DataFrame:
    """Decisions of a second screening replace the first's, matched on the trimmed lower-case title."""
    key = F.lower(strip(F.col("title")))
    again = recovered.groupBy(key.alias("__k")).agg(F.max_by(F.struct(F.col("decision").alias("d"), F.col("screening_reason").alias("r")), "idx").alias("__new"))
    out = original.withColumn("__k", key).join(again, "__k", "left")
    out = out.withColumns({"decision": F.coalesce("__new.d", "decision"), "screening_reason": F.when(F.col("__new").isNotNull(), F.col("__new.r")).otherwise(F.col("screening_reason"))})
    return out.drop("__k", "__new")


def clear_screening(docs: DataFrame, where: Column) -> DataFrame:
    """The records to screen again, without what was decided."""
    return docs.where(where).withColumns({c: F.lit(None).cast(docs.schema[c].dataType) for c in ("decision", "screening_reason", "screening_confidence", "screening_layers") if c in docs.columns})


def summary(docs: DataFrame) -> DataFrame:
    return docs.groupBy(F.coalesce("decision", F.lit("none")).alias("decision")).agg(F.count("*").alias("records"))


Progress = Callable[[str, float], None]
