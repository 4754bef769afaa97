"""Registry of named queries: a Spark plan plus, where expressible, SQL.

Every query takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
tables of ``sf_dir``; some run jobs while they plan (statistics, model fits).  The optional SQL text is the independent oracle
run by DuckDB over the same parquet tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name`` with an optional oracle SQL string."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from . import (  # noqa: F401
        q_clean,
        q_features,
        q_models,
        q_profile,
        q_sources,
        q_timeseries,
    )
