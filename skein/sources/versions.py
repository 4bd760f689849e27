"""Versions of a set of tables: an append-only log says which folders each version consists of, so that a new version shares what hasn't changed, and readers of an old one go on.

A version appears with one file, when everything that it points to is written. Two writers of the same number: the one whose name sorts first has it, the other gets Conflict, and its folders belong to no version.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

_LOG = "number bigint, writer string, name string, part int, level bigint, rows bigint, low string, path string"


class Conflict(RuntimeError):
    """Someone else has published the version's number."""


@dataclass(frozen=True)
class Piece:
    """A folder of a version: the table's name, its part (-1: not in parts), the version that it was written for (level), its rows, and the part's least key if it has one."""

    name: str
    part: int
    level: int
    rows: int
    low: str | None
    path: str


def _log(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(_LOG).json(f"{root.rstrip('/')}/_versions")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _winner(log: DataFrame, number: int) -> str:
    return log.where(F.col("number") == number).agg(F.min("writer")).first()[0]


def latest(spark: SparkSession, root: str) -> int:
    """The number of the version that was published last; 0 if there is none."""
    log = _log(spark, root)
    return 0 if log is None else log.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]


def pieces(spark: SparkSession, root: str, number: int | None = None) -> tuple[int, list[Piece]]:
    """A version's number and its folders, of which there are as many as parts and what has been added to them; the last version unless a number is given."""
    number = latest(spark, root) if number is None else number
    log = _log(spark, root) if number else None
    rows: list[Row] = [] if log is None else log.where((F.col("number") == number) & (F.col("writer") == F.lit(_winner(log, number)))).collect()
    if not rows:
        raise ValueError(f"no version {number or ''} of {root}")
    return number, [Piece(r["name"], r["part"], r["level"], r["rows"], r["low"], r["path"]) for r in rows]


def publish(spark: SparkSession, root: str, number: int, folders: list[Piece]) -> None:
    """Make the folders version `number`."""
    writer = uuid.uuid4().hex
    log = _log(spark, root)
    if log is None or log.where(F.col("number") == number).isEmpty():
        rows = [(number, writer, p.name, p.part, p.level, p.rows, p.low, p.path) for p in folders]
        spark.createDataFrame(rows, _LOG).coalesce(1).write.mode("append").json(f"{root.rstrip('/')}/_versions")  # one file, which is renamed into place
        log = _log(spark, root)
    if _winner(log, number) != writer:
        raise Conflict(f"version {number} of {root} is there already")


def folder(root: str, number: int) -> str:
    """A new folder for what version `number` adds; a name of its own, so that a writer that fails or loses is in nobody's way."""
    return f"{root.rstrip('/')}/v{number}-{uuid.uuid4().hex[:12]}"


def branch(spark: SparkSession, root: str, other: str) -> None:
    """Make the last version of root the first one of other, which shares its folders and goes its own way from there."""
    _, found = pieces(spark, root)
    publish(spark, other, 1, found)


def unused(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Folders that only versions before the last `keep` consist of. Delete them when nobody reads those any more."""
    log = _log(spark, root)
    first = latest(spark, root) - keep + 1
    return [] if log is None else sorted(r[0] for r in log.groupBy("path").agg(F.max("number").alias("n")).where(F.col("n") < first).select("path").collect())
