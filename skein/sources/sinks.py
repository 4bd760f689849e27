"""Tables that are published whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.checks import assert_none
from skein.sources import versions


def publish(tables: dict[str, DataFrame], path: str, checks: dict[str, DataFrame] | None = None) -> str:
    """Write tables as Parquet to a new folder under path, check, and only then make them the last version; readers keep the old one until that and after any failure. Gives the folder.

    checks: rows that must not be there, by what they mean; they may read the staged tables through staged().
    """
    spark = next(iter(tables.values())).sparkSession
    number = versions.latest(spark, path) + 1
    place = versions.folder(path, number)
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{place}/{name}")
    for what, rows in (checks or {}).items():
        assert_none(rows, what)
    versions.publish(spark, path, number, [versions.Piece(name, -1, number, -1, None, f"{place}/{name}") for name in tables])
    return place


def staged(spark: SparkSession, version: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{version}/{name}")


def published(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the version that was published last."""
    _, found = versions.pieces(spark, path)
    return spark.read.parquet(*(p.path for p in found if p.name == name))


def write_report(rows: DataFrame, path: str) -> None:
    """JSON lines with the columns in order of their names. Numbers that JSON doesn't have are refused."""
    numbers = [F.isnan(c) | (F.abs(c) == float("inf")) for c, kind in rows.dtypes if kind in ("double", "float")]
    for wrong in numbers:
        assert_none(rows.where(wrong), "a report has a number that isn't finite")
    rows.select(*sorted(rows.columns)).write.mode("errorifexists").json(path)
