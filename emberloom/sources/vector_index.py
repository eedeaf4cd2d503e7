"""A table of unit vectors as an exact index: validated when built and when read, published as a generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberloom.functions import vectors
from emberloom.sources import sinks


def violations(rows: DataFrame, dims: int, key: str = "id", vector: str = "vector") -> DataFrame:
    """Rows that an index may not hold, with the reason: no key, a key twice, wrong dimension, not finite or not of unit length."""
    twice = rows.groupBy(key).agg(F.count("*").alias("_n"))
    reason = (
        F.when(F.col(key).isNull(), "no_key").when(F.col("_n") > 1, "key_twice").when(F.coalesce(F.size(vector), F.lit(-1)) != dims, "dimension")
        .when(~F.coalesce(vectors.is_unit(vector), F.lit(False)), "not_unit")
    )
    return rows.join(twice, key, "left").select(key, reason.alias("reason")).where("reason is not null")


def build(rows: DataFrame, root: str, generation: str, dims: int, key: str = "id", vector: str = "vector") -> None:
    """Publish the vectors, all or nothing: any violation, or no row, fails before a manifest is written."""
    found = violations(rows, dims, key, vector).agg(F.count("*").alias("n"), F.min(F.struct("reason", F.col(key).cast("string").alias("k"))).alias("first")).first()
    if found["n"]:
        raise ValueError(f"{found['n']} vectors are not valid, such as {found['first']['k']}: {found['first']['reason']}")
    if rows.limit(1).count() == 0:
        raise ValueError("an index needs a vector")
    sinks.publish(rows.select(F.col(key).alias("id"), F.col(vector).alias("vector")), root, generation)


def load(spark: SparkSession, root: str, dims: int) -> DataFrame:
    """The last generation, checked against its manifest and the index's rules."""
    rows = sinks.latest(spark, root)
    bad = violations(rows, dims).limit(1).collect()
    if bad:
        raise ValueError(f"the index holds a vector that is not valid: {bad[0]['reason']}")
    return rows
