"""Registry of queries: a Spark callable and, where SQL can say it, the DuckDB text it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.plans.fixtures import Fixtures
from gridloom.plans.oracle_views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable:
    """Register a function of the fixtures; ``views`` names the derived views its SQL reads."""

    def register(fn: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Fixtures(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(views.split(), sql.strip())
        return fn

    return register
