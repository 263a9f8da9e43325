"""Named queries over the shared test tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name."""

    def keep(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            TWINS[function.__name__] = sql
        return function

    return keep
