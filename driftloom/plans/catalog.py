"""All queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftloom.plans import drift_queries, harness, stream_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**stream_queries.Q, **drift_queries.Q, **harness.Q}


def oracle_sql() -> dict[str, str]:
    return {**stream_queries.O, **drift_queries.O}
