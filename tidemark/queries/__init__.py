"""Registered queries, one per feature, grouped as in the feature list."""

from tidemark.queries import (  # noqa: F401
    kinds_queries,
    monitoring,
    refresh_queries,
    requests,
    resampling,
    scoring_queries,
    tables_queries,
    usage_queries,
)
from tidemark.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
