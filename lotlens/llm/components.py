"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (longs; either order, repeats and loops allowed). Returns node, root: the smallest node reachable.

    Nodes without an edge to another node aren't listed. Every step is a grouping with map-side combining and a
    join of stored tables, whose hot keys adaptive execution splits; the star that a large component becomes is
    a set of rows, never one group in a task. Each step is written to the shared folder.
    """

    def minima(e: DataFrame) -> DataFrame:
        return stored(e.groupBy("u").agg(F.min("v").alias("m")))

    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = state
        # Large star: each larger neighbour of u goes to the smallest of u and its neighbours.
        both = stored(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = stored(both.where("v > u").join(minima(both), "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct())
        # Small star: each smaller neighbour of u, and u, go to the smallest.
        least = minima(large)
        now = stored(large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
