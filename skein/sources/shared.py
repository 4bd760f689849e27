"""A folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, local mode, whose tasks share the driver's disk, gets one of its own; on a cluster that is an error."""
    context = spark.sparkContext
    place = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not place:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="skein-")
        context.setCheckpointDir(place)
        place = context.getCheckpointDir() or place
    return f"{place.rstrip('/')}/skein-{context.applicationId}"


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """For writes: nothing asks for the shuffle files behind a table again once it is written, so Spark is told to drop them then."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in that folder: what follows reads the same rows however often it does, also with executors lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with dropping_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
