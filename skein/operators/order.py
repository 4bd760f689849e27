"""Numbers and running sums over a whole table in an order, without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.sources.shared import stored

_BITS = 33  # of monotonically_increasing_id() within a partition


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with a column for each of sums: its sum over the rows up to each, in the order given, which must have no ties.

    Ranges of the order are partitions; sums within them, and those of the ranges before, of which there are as many as partitions.
    """
    ranged = rows.withColumns({f"__{k}": v for k, v in sums.items()}).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumn("__at", F.monotonically_increasing_id()), "ordered").withColumn("__part", F.shiftright("__at", _BITS))
    parts = ranged.groupBy("__part").agg(*(F.sum(f"__{k}").alias(f"__all_{k}") for k in sums))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__part", *(F.coalesce(F.sum(f"__all_{k}").over(before), F.lit(0)).alias(f"__before_{k}") for k in sums))
    within = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.join(F.broadcast(parts), "__part")
    return own.select(*rows.columns, *((F.col(f"__before_{k}") + F.sum(f"__{k}").over(within)).alias(k) for k in sums))


def numbered(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """rows with a number from 1 on in the order given, which must have no ties."""
    return running(rows, order, {out: F.lit(1)}).withColumn(out, F.col(out).cast("bigint"))
