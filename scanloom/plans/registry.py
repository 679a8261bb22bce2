"""Registry of named queries: a Spark callable and, where SQL can say it, a DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scanloom.plans.testbed import Testbed, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, expand: Callable[[str], str] = oracle):
    """Register ``fn(testbed) -> DataFrame`` under ``name`` (survey id and a word or two)."""
    def register(fn: Callable[[Testbed], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Testbed(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = expand(sql)
        return fn
    return register
