"""Connected components of small key graphs (case groups, families)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberloom.session import use_checkpoint_dir


def groups_by_shared_key(rows: DataFrame, node: str, key: str) -> DataFrame:
    """(node, root): nodes that share a key, directly or over others, get the least of them.

    Labels go from nodes to keys and back by minima, with map-side combine; the
    labels are checkpointed each round so that the lineage stays short.
    """
    use_checkpoint_dir(rows.sparkSession)
    edges = rows.where(F.col(node).isNotNull()).select(node, key).distinct().checkpoint()
    labels = edges.select(node).distinct().withColumn("root", F.col(node)).checkpoint()
    linked = edges.where(F.col(key).isNotNull())
    while True:
        per_key = linked.join(labels, node).groupBy(key).agg(F.min("root").alias("r"))
        reached = linked.join(per_key, key).groupBy(node).agg(F.min("r").alias("r"))
        new = labels.join(reached, node, "left").select(node, F.least("root", F.coalesce("r", "root")).alias("root"))
        # the root's own root: halves the length of chains
        up = new.select(F.col(node).alias("root"), F.col("root").alias("above"))
        new = new.join(up, "root", "left").select(node, F.coalesce("above", "root").alias("root")).checkpoint()
        moved = new.alias("a").join(labels.alias("b"), node).where("a.root <> b.root").limit(1).count()
        labels = new
        if not moved:
            return labels
