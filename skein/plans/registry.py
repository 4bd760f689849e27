"""Where queries register under their names, with the SQL that gives the same rows in DuckDB where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (read, spark), where read(table) gives a table's DataFrame."""

    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark)

        run.__doc__ = function.__doc__
        run.__name__ = name
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return function

    return register
