"""Sinks: versioned tables whose manifest is written last, and stream batches merged by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberloom.operators import merge


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def publish(df: DataFrame, root: str, generation: str) -> None:
    """Write a generation, then its manifest: readers see it whole or not at all."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{root}/data/{generation}")
    stored = spark.read.parquet(f"{root}/data/{generation}")
    checksum = stored.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*stored.columns).cast("decimal(38,0)")).cast("string").alias("checksum"))
    checksum.select(F.lit(generation).alias("generation"), F.current_timestamp().alias("published"), "rows", "checksum").write.mode("append").parquet(f"{root}/manifest")


def latest(spark: SparkSession, root: str) -> DataFrame:
    """The last published generation; fails if its rows are not those of the manifest."""
    last = spark.read.parquet(f"{root}/manifest").orderBy(F.desc("published"), F.desc("generation")).first()
    stored = spark.read.parquet(f"{root}/data/{last['generation']}")
    rows, checksum = stored.agg(F.count("*"), F.sum(F.xxhash64(*stored.columns).cast("decimal(38,0)")).cast("string")).first()
    if (rows, checksum) != (last["rows"], last["checksum"]):
        raise ValueError(f"generation {last['generation']} is damaged: {rows} rows, {last['rows']} in its manifest")
    return stored


def generations(spark: SparkSession, root: str) -> list[str]:
    fs, path = _fs(spark, f"{root}/manifest")
    if not fs.exists(path):
        return []
    return [r["generation"] for r in spark.read.parquet(f"{root}/manifest").orderBy("published", "generation").collect()]


def merge_stream(stream: DataFrame, root: str, key: str, version: str, checkpoint: str, **trigger):
    """Each micro-batch is merged by key into the last generation; a batch that is run again changes nothing."""

    def batch(rows: DataFrame, number: int) -> None:
        name = f"batch-{number:010d}"
        spark = rows.sparkSession
        known = generations(spark, root)
        if name in known:
            return
        merged = merge.upsert(latest(spark, root), rows, key, version) if known else merge.upsert(rows.limit(0), rows, key, version)
        publish(merged, root, name)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
