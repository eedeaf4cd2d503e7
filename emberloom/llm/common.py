"""Shared helpers: reading tables, writing intermediate tables, bounded collects, workers that give memory back."""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; only in a local session a temporary one is made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="emberloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _remove_at_exit(spark: SparkSession, path: str, name: str | None = None) -> None:
    context = spark.sparkContext
    if context._jsc is not None and not context._jsc.sc().isStopped():
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)


def materialise(df: DataFrame, label: str, **options: int | str) -> DataFrame:
    """Write df as Parquet into the shared folder, with the writer's options, and read it back.

    This cuts the lineage: a lost executor later costs a re-read, not a
    recomputation, and every reader of the result sees the same rows. The
    folder goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/emberloom/{label}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    atexit.register(_remove_at_exit, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """Write df into the shared folder in buckets of key: what is joined to it by key moves, its own rows don't.

    It is written as it comes, without compression (for columns compressed already), and goes when the driver ends.
    """
    spark = df.sparkSession
    name = f"emberloom_{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/emberloom/{name}"
    df.write.format("parquet").option("compression", "none").option("path", path).bucketBy(min(buckets, 100_000), key).saveAsTable(name)
    atexit.register(_remove_at_exit, spark, path, name)
    return spark.table(name)


#: What this worker keeps from task to task; the keys begin with the operator's name.
_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make):
    """What a worker keeps from task to task under key; only the last key's is kept."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget_others(operator: str) -> None:
    """Let go of what this worker keeps for other operators."""
    for key in [k for k in _KEPT if k[0] != operator]:
        del _KEPT[key]


def give_back() -> None:
    """Hand freed memory back to the system: allocators keep it, and a worker serves one operator after the other."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def frugal(step, operator: str = ""):
    """A step for mapInArrow that starts without what other operators have kept and ends without memory that it no longer needs."""

    def run(batches):
        forget_others(operator)
        try:
            yield from step(batches)
        finally:
            give_back()

    return run
