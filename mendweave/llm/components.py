"""Connected components by alternating large-star and small-star steps, each a join and an aggregate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Edges that a task handles, about: small steps are not spread over all partitions, which would cost files and time.
SPREAD = 100_000
LEAST_TASKS = 8


def _large(edges: DataFrame, few: Callable[[DataFrame], DataFrame]) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return few(few(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())


def _small(edges: DataFrame, few: Callable[[DataFrame], DataFrame]) -> DataFrame:
    least = few(edges.groupBy("u").agg(F.min("v").alias("m")))
    met = few(edges.join(least, "u"))
    return met.select("u", F.col("m").alias("v")).union(met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """From edges (u, v) between distinct numbers: node and root, the smallest node of its component, for each node
    but the roots. Every round is written to the shared checkpoint folder; nodes and edges stay on the executors.

    Rounds go on until the edges stay as they are, which they do after a number of rounds that grows as the square of the
    logarithm of the nodes at most. A node with very many edges only meets aggregates with partial sums and joins that Spark
    can split.
    """
    edges = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    digest = [F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("s"), F.bit_xor(F.xxhash64("u", "v")).alias("x")]
    before, after = None, edges.agg(*digest).first()
    while after["n"] and after != before:
        before, tasks = after, max(LEAST_TASKS, after["n"] // SPREAD)

        def few(df: DataFrame, tasks: int = tasks) -> DataFrame:
            return df.coalesce(tasks)

        edges = saved(few(_small(_large(few(edges), few), few)))
        after = edges.agg(*digest).first()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
