"""Named queries and their DuckDB oracles."""

from __future__ import annotations

from . import calibration, extras, fixes, linkgraph, monitoring, optimizer, pages, pillars, questions, relational, responses, retrieval, scoring, streams, structure, texts  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
