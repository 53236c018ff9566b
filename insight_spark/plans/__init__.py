"""Importing this package registers every query."""

from insight_spark.plans import (  # noqa: F401
    profile_queries,
    question_queries,
    retrieval_queries,
    series_queries,
    source_queries,
    table_queries,
    text_queries,
)
from insight_spark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
