"""Integrity checks that give rows: what is wrong, or how many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inventory_differences(listed: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """side and key: rows that are listed and missing, or there and unlisted. Bags, so that repeated rows count."""
    return listed.select(key).exceptAll(actual.select(key)).select(F.lit("missing").alias("side"), key).unionByName(actual.select(key).exceptAll(listed.select(key)).select(F.lit("unlisted").alias("side"), key))


def orphans(link: str, rows: DataFrame, key: str, parents: DataFrame, parent: str) -> DataFrame:
    """One row: how many rows have a key that no parent has."""
    lost = rows.select(F.col(key).alias("__k")).where("__k is not null").join(parents.select(F.col(parent).alias("__k")), "__k", "left_anti")
    return lost.agg(F.lit(link).alias("link"), F.count(F.lit(1)).alias("orphans")).select("link", "orphans")


def contiguous(rows: DataFrame, key: str, first: int) -> DataFrame:
    """One row: n, and whether the keys are all numbers from first on, each once."""
    n = F.count(F.lit(1))
    return rows.agg(n.alias("n"), ((F.min(key) == first) & (F.max(key) == n + (first - 1)) & (F.countDistinct(key) == n)).alias("contiguous"))


def vector_shape(rows: DataFrame, vector: str, dims: int) -> DataFrame:
    n = F.count(F.lit(1))
    return rows.agg(n.alias("n"), (n * dims * 2).alias("half_bytes"), F.count_if(F.coalesce(F.size(vector), F.lit(-1)) != dims).alias("bad_length"))


def verify_files(listed: DataFrame, actual: DataFrame, key: str, size: str, digest: str) -> DataFrame:
    """key and state: ok, missing, unlisted, bytes or digest."""
    a, b = listed.select(key, F.col(size).alias("ls"), F.col(digest).alias("ld")), actual.select(key, F.col(size).alias("s"), F.col(digest).alias("d"))
    state = F.when(F.col("s").isNull(), "missing").when(F.col("ls").isNull(), "unlisted").when(F.col("ls") != F.col("s"), "bytes").when(F.col("ld") != F.col("d"), "digest").otherwise("ok")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def assert_none(rows: DataFrame, what: str) -> None:
    """Fails if there is a row."""
    found = rows.agg(F.any_value(F.struct("*"))).first()[0]  # a limit would look through the partitions one after the other
    if found is not None:
        raise ValueError(f"{what}: {found}")
