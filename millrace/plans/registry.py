"""All queries of the engine by name, with DuckDB SQL for each where it can be expressed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import analytics, relational

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (relational, analytics):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
