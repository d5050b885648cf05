"""Wellspring: Spark-first analytics for retrieval quality, scoring and corpus preparation."""

__version__ = "0.1.0"
