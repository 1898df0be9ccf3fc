"""Composed jobs and the registry of checked queries."""

from flowsentry.plans import detect_queries, model_queries, stream_queries  # noqa: F401  (they register their queries)
from flowsentry.plans.registry import QUERIES

__all__ = ["QUERIES"]
