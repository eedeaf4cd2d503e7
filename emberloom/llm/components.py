"""Connected components of an edge table by alternating large and small stars.

Both star steps are an aggregation (with map-side combine) and a join back, so
a hub's edges are never brought together in one task. Each round is written to
the shared folder; the rounds grow with the logarithm of a component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges of one orderable type -> (node, root): root is the least node reachable.

    Nodes without an edge, and edges from a node to itself, are not returned.
    """
    now = materialise(edges.where("u <> v").select("u", "v").distinct(), "edges")
    state = None
    while True:
        now = materialise(_small_star(materialise(_large_star(now).distinct(), "large")).distinct(), "small")
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sums) == state:
            break
        state = tuple(sums)
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(roots).groupBy("node").agg(F.min("root").alias("root"))
