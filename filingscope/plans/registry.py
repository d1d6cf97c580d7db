"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from filingscope.plans.oracle_base import with_ctes

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, lca_where: str | None = None, raw_sql: bool = False):
    """Decorator.  ``sql`` is the oracle body; the base CTEs are prepended
    unless ``raw_sql`` is set."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip() if raw_sql else with_ctes(sql, lca_where)
        return fn

    return deco
