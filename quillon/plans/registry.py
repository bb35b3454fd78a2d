"""Registered queries: a Spark function of (spark, folder) and, where SQL can express it, the same as standard SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
MODULES = ("panels", "books", "statistics", "screens", "graphs", "scores", "catalogue", "estimators", "printed", "papers", "regressions", "strategies", "streams", "reports", "studies", "notes", "feeds", "published")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for m in MODULES:
        importlib.import_module(f"quillon.plans.{m}")
    return QUERIES, SQL
