"""Registered queries and their DuckDB counterparts, one module for each group of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.queries import archives, captures, documents, hosts, index, ledgers, relational, streams  # noqa: F401  they register
from weftline.queries.registry import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
