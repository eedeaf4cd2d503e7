"""Merging and reconciling keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(*columns: str) -> Column:
    """Canonical hash of a record: its columns in name order as JSON."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def upsert(current: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the highest version of each key."""
    both = current.unionByName(incoming)
    others = [c for c in both.columns if c != key]
    newest = both.groupBy(key).agg(F.max_by(F.struct(*others), F.col(version)).alias("r"))
    return newest.select(key, *[F.col(f"r.{c}").alias(c) for c in others])


def pruned(stored: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Stored rows whose key the source does not have."""
    return stored.join(source.select(key), key, "left_anti")


def staged(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Per key of either table: inserted, unchanged, conflict or kept."""
    columns = [c for c in current.columns if c != key]
    a = current.select(key, row_hash(*columns).alias("before"))
    b = incoming.select(key, row_hash(*columns).alias("after"))
    state = (
        F.when(F.col("before").isNull(), "inserted")
        .when(F.col("after").isNull(), "kept")
        .when(F.col("before") == F.col("after"), "unchanged")
        .otherwise("conflict")
    )
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def merge_or_fail(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Union of both; a key with different contents fails the whole merge before anything is written."""
    conflicts = staged(current, incoming, key).where("state = 'conflict'").agg(F.count("*").alias("n"), F.min(F.col(key).cast("string")).alias("k"))
    failed = F.when(F.col("n") > 0, F.raise_error(F.concat(F.lit("conflicting record "), F.col("k")))).otherwise(F.lit(False))
    # one row, joined to what would be written: nothing passes before the check did
    checked = conflicts.select(failed.cast("boolean").alias("_failed"))
    fresh = incoming.join(current.select(key), key, "left_anti")
    both = current.unionByName(fresh).crossJoin(F.broadcast(checked))
    return both.where(~F.coalesce("_failed", F.lit(False))).drop("_failed")


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Key counts on the left only, on the right only and on both sides."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(True)), right.select(key).distinct().withColumn("r", F.lit(True))
    return a.join(b, key, "full_outer").agg(
        F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"), F.count_if(F.col("l") & F.col("r")).alias("both")
    )


def refill(current: DataFrame, previous: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns of a previous version by full key, else by the first key if it had one row; blanks never overwrite."""
    full = previous.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    single = previous.groupBy(keys[0]).agg(F.count("*").alias("_n"), *[F.first(c).alias(f"_one_{c}") for c in columns]).where("_n = 1").drop("_n")
    joined = current.join(full, keys, "left").join(single, keys[0], "left")
    filled = {c: F.coalesce(F.nullif(F.trim(f"_{c}"), F.lit("")), F.nullif(F.trim(f"_one_{c}"), F.lit("")), F.col(c)) for c in columns}
    return joined.withColumns(filled).drop(*[f"_{c}" for c in columns], *[f"_one_{c}" for c in columns])


def changed_cells(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Per column: rows of old that are missing or differ in new."""
    columns = [c for c in old.columns if c != key]
    joined = old.alias("a").join(new.alias("b"), key, "left")
    counts = [F.count_if(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias(c) for c in columns]
    return joined.agg(*counts).select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*columns))).alias("column", "changed"))
