"""Helpers shared by the corpus operators: table access, scratch tables on the shared store."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Spark's setting to drop a query's shuffle files when the query ends, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BROADCAST_ROWS = 500_000   # rows of a few numbers each


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage like ``checkpoint()``, but columnar and compressed; the copy is on the
    store all executors share, so a lost executor costs only its running tasks. Nothing reads
    the shuffle files of the write once it is done, so they go at once.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ladderkit-{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to be broadcast if it was counted to be small, else as it is, to be shuffled. Spark's own
    choice goes by file sizes before filters, or comes when the other side is on disk already."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(key: Column, m: int) -> Column:
    """crc32 of the key as text, modulo ``m``; a null key counts as remainder 0."""
    return F.coalesce(F.crc32(key.cast("string")) % m, F.lit(0))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge.

    Alternating large-star and small-star rounds on edge sets, every round one group-by on
    the shuffle and one scratch table; the number of rounds grows with the logarithm of the
    longest chain. Each group is reduced by ``min`` before it is joined back, so no task
    gathers the neighbours of a hub.
    """
    cur = stash(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                .filter("u <> v").distinct(), "cc")
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large-star: every larger neighbour of u points to the least of u and its neighbours
        large = (both.filter("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small-star: every smaller neighbour of u, and u, point to the least of them
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        nxt = (large.join(small_low, "u")
               .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                         F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
               .select("e.*").filter("u <> v").distinct())
        nxt = stash(nxt, "cc")
        sums = [d.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
                for d in (cur, nxt)]
        cur = nxt
        if sums[0] == sums[1]:
            break
    return (cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
