"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm._shared import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and label, the smallest node that can be reached, for each node that has an edge.

    Each round takes the least label among a node's neighbours and then that label's own label, so that chains shorten fast; rounds go on until nothing changes. Rounds are written to the
    shared folder. Least labels are combined before the shuffle, so that a hub's edges don't meet in one task.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    links = written(links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "links")
    labels = written(links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).withColumnRenamed("u", "node"), "labels")
    while True:
        near = links.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = written(step, "labels")
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        after = written(after, "labels")
        if after.where("label <> old").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
