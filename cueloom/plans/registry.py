"""Name -> (Spark query, SQL check) table that `__spark_entry__` publishes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cueloom.plans.roles import Source, with_roles
from cueloom.session import ship_package

ship_package()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `build(src)`; `sql` is the same result for the check engine (None = rows-only)."""

    def register(build: Callable[[Source], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: build(Source(spark, folder))
        if sql is not None:
            CHECKS[name] = with_roles(sql)
        return build

    return register
