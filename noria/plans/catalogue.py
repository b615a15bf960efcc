"""All queries of the library by name."""

from __future__ import annotations

from . import corpus_queries, drift_queries, latent_queries, metric_queries, recording_queries, selection_queries, series_queries, sequence_queries, store_queries, text_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES
from .text_queries import flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
