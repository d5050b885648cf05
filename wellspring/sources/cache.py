"""A read-through cache of computed rows by content key, kept as appended Parquet files.

What is looked up is joined with the cache by key; only distinct keys that are missing or too old are computed, appended with their
time, and joined in. Computation runs in the cluster over the missing keys alone. Of several rows of a key the latest counts, so
parallel writers do no harm. The folder must be one that all executors share.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def query_key(query: Column, providers: Column) -> Column:
    """First 16 hex digits of SHA-256 of the query and its sorted providers."""
    return F.substring(F.sha2(F.concat(query, F.lit(":"), F.array_join(F.array_sort(providers), ",")), 256), 1, 16)


class Cache:
    """key and value columns with the time they were computed."""

    def __init__(self, spark: SparkSession, folder: str, value: str, hours: float | None = None):
        """value: DDL of the value columns; hours: how long a row counts (None: for ever)."""
        self.spark, self.folder, self.hours = spark, folder.rstrip("/"), hours
        self.ddl = f"key string, {value}, computed_at timestamp"

    def rows(self) -> DataFrame:
        """All rows ever appended; none before the first."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/rows")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.ddl)
        return self.spark.read.schema(self.ddl).parquet(f"{self.folder}/rows")

    def fresh(self, now: Column) -> DataFrame:
        """The latest row of each key, if it is not too old at now."""
        rows = self.rows()
        if self.hours is not None:
            rows = rows.filter(F.col("computed_at") >= now - F.make_dt_interval(secs=F.lit(self.hours * 3600)))
        cols = [c for c in rows.columns if c != "key"]
        return rows.groupBy("key").agg(F.max_by(F.struct(*cols), "computed_at").alias("_r")).select("key", "_r.*")

    def through(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame], now: dt.datetime | None = None) -> DataFrame:
        """wanted (key, other columns) with the value columns and cached (whether they were there before).

        compute gets one row of wanted for each missing key and returns (key, value columns). Rows without a key get null values.
        """
        at = F.lit(now or self.spark.range(1).select(F.current_timestamp()).first()[0]).cast("timestamp")
        missing = wanted.filter("key IS NOT NULL").join(self.fresh(at).select("key"), "key", "left_anti")
        rest = [c for c in wanted.columns if c != "key"]
        one = missing.groupBy("key").agg(F.min(F.struct(*rest)).alias("_w")).select("key", "_w.*") if rest else missing.distinct()
        new = compute(one).withColumn("computed_at", at)
        new.select(*[f.split()[0] for f in self.ddl.split(", ")]).write.mode("append").parquet(f"{self.folder}/rows")
        rows = self.fresh(at).withColumn("cached", F.col("computed_at") < at).drop("computed_at")
        return wanted.join(rows, "key", "left")
