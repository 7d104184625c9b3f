"""Helpers that several operators share: reading tables, shared storage, names, local components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litloom.llm.workers import small_batches
from litloom.operators.graph import components, cut, ensure_checkpoint_dir, free

__all__ = ["NULL_ID", "components", "cut", "free", "local_roots", "partitions_for", "table", "text_of", "with_node", "written"]

#: Stands for a null id where ids are compared: nulls come first.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def partitions_for(n_bytes: int | None, each: int, least: int = 1) -> int:
    """How many groups of about `each` bytes hold n_bytes."""
    return max(least, -(-int(n_bytes or 0) // each))


def with_node(distinct: DataFrame, key: str) -> DataFrame:
    """distinct, one row for each value of a binary key, with node: a 64-bit name of the key.

    The name is a hash; where two keys have one, the lesser keeps it and the others get
    names of their own, so different keys are never taken for each other.
    """
    place = F.row_number().over(Window.partitionBy("__name").orderBy(key))
    out = distinct.withColumn("__name", F.xxhash64(key)).withColumn("__place", place)
    return out.withColumn("node", F.when(F.col("__place") == 1, F.col("__name")).otherwise(F.xxhash64(key, "__place"))).drop("__name", "__place")


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the places 0 to n - 1 and pairs of them: the least place reachable from each."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """Writes a frame as Parquet into the shared checkpoint folder; the table read again, and its path."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    free(spark)
    return spark.read.parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Removes a table that `written` made, once nothing reads it any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
