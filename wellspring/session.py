"""Session settings the library is tuned for; every entry can be overridden by the caller."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with DEFAULTS, then ``conf`` on top (keys use ``_`` for ``.``)."""
    b = SparkSession.builder.config(map=DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()})
    if master:
        b = b.master(master)
    return b.getOrCreate()
