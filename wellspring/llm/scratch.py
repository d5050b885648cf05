"""Shared scratch storage, sized broadcasts and distributed ranks used by the operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

BROADCAST_ROWS = 100_000


def folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a local one only where it is unset and the master is local."""
    where = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_wellspring_scratch", None)
    if where is None:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            where = jdir.get()
        elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-"):
            where = "file://" + tempfile.mkdtemp(prefix="wellspring-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark._wellspring_scratch = where
    return where.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone; leftovers in a scratch folder do no harm
        pass


def table(df: DataFrame, name: str = "t", by: str | None = None) -> DataFrame:
    """Write df to shared scratch, in folders of column ``by`` if given, and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{folder(spark)}/wellspring-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if df has at most ``rows`` rows; else leave it to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def docs_of(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def ranked(df: DataFrame, key: str, spread: str, order: list[str], out: str, buckets: int) -> DataFrame:
    """Gapless 0-based positions within each ``key``, without one task for a whole key.

    Rows of a key are dealt to ``buckets`` sub-buckets by pmod(``spread``, buckets); positions within
    a sub-bucket come from a window, and sub-bucket offsets from running sums of the counts, a table
    of at most keys x buckets rows. df must be stable when read twice (a scratch table).
    """
    b = df.withColumn("_b", F.pmod(F.col(spread), F.lit(buckets)).cast("int"))
    counts = b.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    run = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offs = counts.select(F.col(key).alias("_k"), F.col("_b").alias("_ob"), F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_off"))
    pos = F.row_number().over(W.partitionBy(key, "_b").orderBy(*order))
    return (
        b.withColumn("_r", pos)
        .join(small(offs), (F.col(key).eqNullSafe(F.col("_k"))) & (F.col("_b") == F.col("_ob")), "left")
        .withColumn(out, F.col("_r") - 1 + F.col("_off"))
        .drop("_b", "_k", "_ob", "_off", "_r")
    )
