"""Named queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagelake.plans.oracle import with_ctes

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, needs: tuple[str, ...] = (), sql: str | None = None, recursive: bool = False):
    """Register a query; ``needs`` names the derived tables that ``sql`` reads."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_ctes(needs, sql, recursive) if needs else sql.strip()
        return fn

    return add
