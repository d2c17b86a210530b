"""The registry of the reference-derived queries and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from learngraph.plans import generation_queries, graph_queries, quality_queries, text_queries, vector_queries

MODULES = (text_queries, quality_queries, graph_queries, vector_queries, generation_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in MODULES:
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES:
        found |= module.ORACLES
    return found
