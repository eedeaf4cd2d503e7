"""Registries of queries and their DuckDB oracles, and tables bound under other names in both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Bound:
    """A test table with columns given by expressions that both engines read alike."""

    def __init__(self, table: str, **columns: str):
        self.table, self.columns = table, columns
        self.sql = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {table}"

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return read(spark, sf_dir, self.table).selectExpr(*[f"{e} AS {n}" for n, e in self.columns.items()])
