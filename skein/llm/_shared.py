"""Folders that all executors share, and joins that stand a hot key."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, local mode, whose tasks share the driver's disk, gets one of its own; on a cluster that is an error."""
    context = spark.sparkContext
    place = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not place:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="skein-checkpoint-")
        context.setCheckpointDir(place)
        place = context.getCheckpointDir() or place
    return f"{place.rstrip('/')}/skein-{context.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it from there: what follows doesn't recompute df, and lost executors lose none of it.

    Nothing asks for the shuffle files behind the table again, so Spark is told to drop them when the table is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def trim() -> None:
    """Gives memory that this process no longer needs back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


#: What a worker calls when a task ends: tables that are made again where they are needed.
AT_END: list[Callable[[], None]] = []


def _ended() -> None:
    """A function of the module, so that what tasks get names it and doesn't hold the tables."""
    for drop in AT_END:
        drop()
    trim()


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, for mapInArrow; when a task ends, its worker, which others use after it, or none, gives the memory that it doesn't need back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            _ended()

    return run


def row_at(df: DataFrame, column: str) -> DataFrame:
    """df with a number of its own for each row."""
    return df.withColumn(column, F.monotonically_increasing_id())


def salted_left_join(left: DataFrame, right: DataFrame, key: str, salt: Column, salts: int = 16) -> DataFrame:
    """Left join to rows of right that are unique by key, with each key of left dealt to several tasks.

    salt: an integer expression over left; right is repeated once for each of its values, so keep right to keys that are repeated in left.
    """
    left = left.withColumn("__salt", F.pmod(salt, F.lit(salts)).cast("int"))
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "__salt"], "left").drop("__salt")


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """Join to rows of right, unique by keys, that know the number n of their rows in left (of about total rows): keys of more than 1/10,000 of all rows, so fewer than 10,000, are broadcast. left is read twice."""
    hot = F.broadcast(right.where(F.col("n") * 10_000 > total))
    rest = left.join(hot.select(*keys), keys, "left_anti").join(right.where(F.col("n") * 10_000 <= total), keys, how)
    return left.join(hot, keys).unionByName(rest)
