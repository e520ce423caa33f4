"""Registered queries: every operator on the given tables, with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = ("validation", "profiling", "evidence", "review", "staging", "reports", "lineage", "sources")


class Registry:
    """Queries of one module with their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return register


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for module in _MODULES:
        out.update(import_module(f"{__name__}.{module}").registry.queries)
    return out


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in _MODULES:
        out.update(import_module(f"{__name__}.{module}").registry.sql)
    return out
