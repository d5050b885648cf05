"""Connected components by alternating large-star and small-star rounds, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _star(e: DataFrame, large: bool) -> DataFrame:
    """One round over edges (a, b): connect each node's larger (or smaller) neighbours to its least one."""
    if large:
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least, "a").select("b", "m").union(least.select("a", "m")).toDF("a", "b")
    out = out.filter(F.col("a") != F.col("b"))
    return out if large else out.distinct()  # repeats of a large star, at most one an edge, go with those of the small star after it


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b) -> (node, root), the root being the least node reachable; only nodes with an edge.

    Stops when a large- and a small-star round leave the edges as they were (compared by count and
    an order-free checksum). Each round is written to shared scratch, so a lost executor costs no lineage.
    """
    e = scratch.table(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        e = scratch.table(_star(_star(e, True), False), "edges")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b"), F.col("b")).distinct())
        mark = now
    raise RuntimeError("components did not settle; raise rounds")
