"""Where plans register their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Registers a plan under its function's name, with its SQL where SQL can express it."""

    def add(f: QueryFn) -> QueryFn:
        key = name or f.__name__
        assert key not in QUERIES, key
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return add
