"""Samples of labelled documents for the classifiers, bounded in rows and in bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a classifier is fitted on at most.
MOST_BYTES = 64 << 20


def fitting(rows: list, most_bytes: int = MOST_BYTES) -> list:
    """The rows in their order, without those that would exceed the bytes left; rows have size."""
    out, left = [], most_bytes
    for r in rows:
        if r["size"] <= left:
            out.append(r)
            left -= r["size"]
    return out


def texts_of(docs: DataFrame, picked: list[tuple[int, int]]) -> dict[tuple[int, int], str]:
    """The texts of the picked (hash of the id, hash of the text): bounded by the pick, which has their sizes."""
    if not picked:
        return {}
    keys = docs.sparkSession.createDataFrame(sorted(set(picked)), "__h long, __t long")
    own = docs.select(F.xxhash64("doc_id").alias("__h"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__t"), F.coalesce("text", F.lit("")).alias("text"))
    rows = own.join(F.broadcast(keys), ["__h", "__t"]).dropDuplicates(["__h", "__t"])
    return {(r["__h"], r["__t"]): r["text"] for r in rows.collect()}


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, training: Column, bound: int, most_bytes: int = MOST_BYTES) -> list[tuple[str, int]]:
    """(text, 0 or 1) of at most `bound` training rows with a label, those whose doc_id has the least hash.

    Of these, texts that do not fit into what is left of most_bytes are passed over; their
    sizes are known before any text is fetched.  The chosen ids are at most `bound`, so they
    are broadcast to the documents; rows of labels that repeat or contradict each other count
    as their greatest.
    """
    own = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(training)
    own = own.groupBy(F.col("doc_id").alias("__id")).agg(F.max(label).cast("int").alias("__y"))
    own = own.withColumn("__h", F.xxhash64("__id")).orderBy("__h", "__id").limit(bound)
    text = F.coalesce("text", F.lit(""))
    rows = docs.join(F.broadcast(own), F.col("doc_id") == F.col("__id")).select(F.xxhash64("doc_id").alias("h"), F.xxhash64(text).alias("t"), F.octet_length(text).alias("size"), F.col("__y").alias("y"))
    rows = fitting(rows.orderBy("h", "t").limit(bound).collect(), most_bytes)
    found = texts_of(docs, [(r["h"], r["t"]) for r in rows])
    return [(found[r["h"], r["t"]], r["y"]) for r in rows]


def held_out(folds: int, out: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == out, F.lit(False))
