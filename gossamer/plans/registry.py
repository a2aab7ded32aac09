"""Named queries over the test tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gossamer.plans import data_queries, run_queries, site_queries, store_queries, testbed


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: overview of a snapshot."""
    return store_queries.QUERIES["e1_overview"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return store_queries.QUERIES | data_queries.QUERIES | run_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return {k: testbed.for_duckdb(v) for k, v in site_queries.SQL.items()} | data_queries.SQL | run_queries.SQL
