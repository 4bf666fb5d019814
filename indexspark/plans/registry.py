"""Registry of named queries (Spark callables) and their DuckDB oracle SQL.

A query is a function ``(spark, sf_dir) -> DataFrame``; an oracle is an ANSI SQL string over the same tables with the
same output column names. Queries without an oracle are checked by row count only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from . import (  # noqa: F401
        extended_queries, extension_queries, goal_oracles, goal_queries, hierarchy_queries, operator_queries, storage_queries, store_queries,
    )
