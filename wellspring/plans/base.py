"""Registry of named queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SRC: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register f(t), where t(table) reads one of the driver's tables."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[name], SRC[name] = run, f.__module__
        if oracle:
            ORACLES[name] = oracle
        return f

    return put
