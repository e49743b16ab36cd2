"""Collects the registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parley.plans import views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `sql` is a SELECT (or further views and a SELECT) over the views."""

    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            glue = ", " if sql.lstrip().startswith("--more") else " "
            ORACLE[name] = views.SQL.rstrip() + glue + sql.replace("--more", "", 1)
        return run

    return add
