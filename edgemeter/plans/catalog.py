"""Registry of the queries and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


CATALOG: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under `name` with the SQL that must agree with it."""

    def register(run: Query) -> Query:
        if name in CATALOG:
            raise ValueError(f"query {name!r} is registered twice")
        CATALOG[name] = Entry(run, sql)
        return run

    return register


def load() -> dict[str, Entry]:
    """Import the modules that register queries."""
    from edgemeter.plans import (  # noqa: F401
        evaluation_queries,
        matrix_queries,
        network_queries,
        rollup_queries,
    )

    return CATALOG
