"""Session factory for local use, tests and the benchmark harness."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def use_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoints go to the folder that spark.checkpoint.dir names; only a local session may go without and gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="emberloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def local_session(cores: int | None = None, app: str = "emberloom", **conf: str) -> SparkSession:
    """A local session with UTC timestamps, AQE and few shuffle partitions.

    On a cluster the session is made by the submitter; nothing in the package
    depends on this one.
    """
    cores = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.shuffle.partitions": str(max(8, cores)),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("EMBERLOOM_DRIVER_MEMORY", "8g"),
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
