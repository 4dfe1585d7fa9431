"""Registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.queries import apps, functions, joins, rows, rules, state, streams, windows  # noqa: F401  they register themselves
from tidewright.queries.registry import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, keyed tumbling window and inline aggregates over the event stream."""
    return QUERIES["tumbling_keyed"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
