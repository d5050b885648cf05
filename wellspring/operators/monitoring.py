"""Fixes, deltas, trends and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Expected points by reason (least, expected, most), multipliers by affected questions.
IMPACT = {"missing_pricing": (2.5, 4.5, 7.0), "missing_contact": (2.0, 3.5, 5.0), "missing_features": (2.0, 4.0, 6.0), "buried_answer": (1.0, 2.5, 4.0), "trust_gap": (1.0, 2.5, 4.0)}
MULTIPLIERS = [1.0, 1.5, 1.8, 2.0, 2.2]


def impact_totals(fixes: DataFrame, site: str, most: float = 30.0) -> DataFrame:
    """Plan total: expected points by falling size, each later fix worth 0.8 of the last, at most ``most``."""
    r = F.row_number().over(Window.partitionBy(site).orderBy(F.desc("expected"), "reason"))
    return fixes.withColumn("_p", F.col("expected") * F.pow(F.lit(0.8), r - 1)).groupBy(site).agg(F.round(F.least(F.lit(most), F.sum("_p")), 4).alias("total"), F.count(F.lit(1)).alias("fixes"))


def question_multiplier(n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MULTIPLIERS)), F.greatest(F.lit(1), F.least(n, F.lit(len(MULTIPLIERS)))).cast("int"))


def direction(delta: Column) -> Column:
    return F.when(delta >= 0.5, "improved").when(delta <= -0.5, "declined").otherwise("stable")


def significance(delta: Column) -> Column:
    d = F.abs(delta)
    return F.when(d >= 10, "major").when(d >= 5, "moderate").when(d >= 1, "minor").otherwise("negligible")


def daily(events: DataFrame, user: str = "user_id") -> DataFrame:
    """(user, day, score): mean value of a user's day; the snapshots of the trend operators."""
    return events.groupBy(user, F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 4).alias("score"))


def deltas(snapshots: DataFrame, user: str = "user_id") -> DataFrame:
    prev = F.lag("score").over(Window.partitionBy(user).orderBy("day"))
    return snapshots.withColumn("prev", prev).withColumn("delta", F.round(F.col("score") - F.col("prev"), 4))


def alerts(d: DataFrame, threshold: float = 40.0) -> DataFrame:
    """Drops below -5, rises of 10 or more, and crossings of the critical threshold."""
    kind = F.when((F.col("prev") >= threshold) & (F.col("score") < threshold), "critical").when(F.col("delta") < -5, "drop").when(F.col("delta") >= 10, "improvement")
    return d.withColumn("alert", kind).filter("alert IS NOT NULL")
