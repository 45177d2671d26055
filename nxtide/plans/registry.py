"""Registered queries and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}
MODULES = ("relational", "detection", "more", "zones", "files", "streamed", "searches", "loads")


def query(sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) by its name; sql gives the same rows on the same tables."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    for m in MODULES:
        import_module(f"nxtide.plans.{m}")
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)
