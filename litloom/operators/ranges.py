"""Rows dealt to ranges of a sorted column, so that running numbers need no single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litloom.operators.graph import cut

#: Rows of a range.
RANGE_ROWS = 250_000
MOST_RANGES = 20_000


def ranged(df: DataFrame, column: str) -> DataFrame:
    """df with __part, the number of the range that holds the column, by approximate percentiles; kept in shared storage."""
    df = cut(df)
    parts = min(MOST_RANGES, 1 + df.count() // RANGE_ROWS)
    kind = df.schema[column].dataType
    edges = df.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else None
    bounds = F.array(*[F.lit(e).cast(kind) for e in sorted(set(edges))]) if edges else None
    return df.withColumn("__part", F.lit(0) if bounds is None else F.size(F.filter(bounds, lambda e: e <= F.col(column))))


def running_before(df: DataFrame, column: str, weight: Column, name: str) -> DataFrame:
    """df, one row for each value of the column, with the sum of the weights of all smaller values.

    Sums by range, MOST_RANGES at most, are added up on the driver; inside a range a window runs.
    """
    parts = ranged(df.withColumn("__w", weight), column)
    before, base = 0, []
    for r in sorted(parts.groupBy("__part").agg(F.sum("__w").alias("w")).collect()):
        base.append((r["__part"], before))
        before += r["w"]
    base = df.sparkSession.createDataFrame(base, "__part int, __base long")
    own = F.sum("__w").over(Window.partitionBy("__part").orderBy(column)) - F.col("__w")
    return parts.withColumn("__own", own).join(F.broadcast(base), "__part").withColumn(name, F.col("__own") + F.col("__base")).drop("__w", "__own", "__base", "__part")
