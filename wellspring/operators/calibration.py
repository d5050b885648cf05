"""Calibration: confusion measures, site splits and experiment arms; searches are in optimizer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import mod_hash
from .retrieval import bounded


def confusion(df: DataFrame, by: list[str], predicted: Column, actual: Column) -> DataFrame:
    """tp, fp, tn, fn by group."""
    return df.groupBy(*by).agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & ~actual).alias("tn"), F.count_if(~predicted & actual).alias("fn"))


def measures(c: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1 and mcc; 0 where a denominator is 0."""
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    mcc = div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return c.withColumns({"accuracy": F.round(div(tp + tn, tp + fp + tn + fn), 6), "precision": F.round(div(tp, tp + fp), 6), "recall": F.round(div(tp, tp + fn), 6), "f1": F.round(div(2 * tp, 2 * tp + fp + fn), 6), "mcc": F.round(mcc, 6)})


def split_sites(df: DataFrame, site: str, when: str, share: float = 0.2) -> DataFrame:
    """df with holdout: the last max(1, share of sites) sites in order of first appearance."""
    first = df.groupBy(site).agg(F.min(when).alias("_first"))
    n = F.count(F.lit(1)).over(Window.partitionBy())
    r = F.row_number().over(Window.orderBy("_first", site))  # one row a site
    s = first.withColumn("holdout", r > n - F.greatest(F.lit(1), F.floor(n * share))).select(site, "holdout")
    return df.join(bounded(s, 1_000_000), site)


def arm(site: Column, allocation: int = 5000) -> Column:
    """treatment for the allocated share of the stable hash, else control."""
    return F.when(mod_hash(site) < allocation, "treatment").otherwise("control")


def chi_square(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Yates-corrected 2 x 2 chi-square; null where a margin is 0."""
    n = a + b + c + d
    diff = F.greatest(F.lit(0.0), F.abs(a * d - b * c) - n / 2)
    return F.try_divide(n * diff * diff, (a + b) * (c + d) * (a + c) * (b + d))
