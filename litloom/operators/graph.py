"""Connected components, and cutting lineage in shared storage."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A node with more than this share of all edge ends, and more than LEAST_DEGREE, is a hub: there are 1 / HUB_SHARE at most.
HUB_SHARE = 0.001
LEAST_DEGREE = 1000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder in spark.checkpoint.dir; one of this machine only in local mode, where the session names none."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="litloom-checkpoint-"))


def free(spark: SparkSession) -> None:
    """Collects what the driver no longer refers to, so that Spark removes the shuffle files of lineage that was cut; on clusters."""
    if not spark.sparkContext.master.startswith("local["):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """df kept in the shared checkpoint folder, its lineage cut; files that only older lineage needs are removed."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    free(df.sparkSession)
    return out


def _with_least(both: DataFrame, low: DataFrame, hubs_above: int | None) -> DataFrame:
    """both with m, the least of each u; that of hubs is broadcast, so their edges stay where they are."""
    if hubs_above is None:
        return both.join(low, "u")
    hubs = F.broadcast(low.where(F.col("n") > hubs_above).select("u", "m"))
    rest = both.join(hubs.select("u"), "u", "left_anti").join(low.where(F.col("n") <= hubs_above).select("u", "m"), "u")
    return both.join(hubs, "u").select("u", "v", "m").unionByName(rest.select("u", "v", "m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable, for every node of an edge between two nodes.

    Large-star and small-star steps in turn (Kiveris et al. 2014): every node hands its
    neighbours its least neighbour until only stars are left, which three numbers tell the
    driver after each round.  Minima are combined before the shuffle.  Self-loops and
    repeated edges do not matter; no edges give no rows; a null end drops its edge.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a) != F.col(b)).distinct())
    while True:
        ends = e.select("u", F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).unionByName(e.select(F.col("v").alias("u"), F.lit(0).alias("as_u"), F.lit(1).alias("as_v")))
        nodes = ends.groupBy("u").agg(F.sum("as_u").alias("up"), F.sum("as_v").alias("down"))
        # In a star each node has one lesser neighbour and no greater one, or no lesser one.
        odd = (F.col("up") > 1) | (F.col("up") == 1) & (F.col("down") > 0)
        n_odd, most, total = nodes.agg(F.count_if(odd), F.max(F.col("up") + F.col("down")), F.sum("up")).first()
        if not n_odd:
            both = e.unionByName(e.select(F.col("v").alias("u"), "v"))
            return both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        limit = max(LEAST_DEGREE, int(2 * total * HUB_SHARE))
        hubs_above = limit if most > limit else None
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both, low, hubs_above).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large if hubs_above is None else cut(large)  # with hubs it is read five times
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        e = cut(_with_least(large, low, hubs_above).select(F.explode(pairs).alias("x")).select("x.*").where("u <> v").distinct())
