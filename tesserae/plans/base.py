"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..tables import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str, name: str | None = None):
    """Register a query under its function's name, with the oracle ``sql`` behind ``views`` if there is one."""

    def add(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = with_views(sql.strip(), *views) if views else sql.strip()
        return f

    return add
