"""Task logs as a stream: keyed state, ordered events, errors as rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.operators.replay import TASK_ROW, Rejected, task_row, task_step

EVENT = "schema_version int, sequence bigint, task_id string, timestamp string, event_type string, correlation_id string, payload string"


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """JSON lines that land in a folder, by a fixed schema; a line that breaks it fails the query. Blank lines are left out."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(folder).where(F.trim("value") != "")
    return lines.select(F.from_json("value", EVENT, {"mode": "FAILFAST"}).alias("e")).select("e.*")


def replay_stream(events: DataFrame) -> DataFrame:
    """A row for each task and batch with events: its state after them, or the error that stopped it.

    Events of a batch are sorted by sequence. A gap, a repeat or a step back is an error, not late data: there is no watermark. A task that is in error, or has ended, rejects what follows.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {"task": None, "error": None}
        for e in pd.concat(list(batches)).sort_values("sequence").to_dict("records"):
            if kept["error"]:
                break
            try:
                before = json.dumps(kept["task"])
                kept["task"] = task_step(kept["task"], e | {"payload": json.loads(e["payload"])})
            except (Rejected, KeyError, ValueError) as why:
                kept = {"task": json.loads(before), "error": str(why) or "invalid event"}
        state.update((json.dumps(kept),))
        yield pd.DataFrame([task_row(key[0], kept["task"], kept["error"])])

    return events.groupBy("task_id").applyInPandasWithState(run, TASK_ROW, "state string", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str, kind: str, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by event-time window with a watermark; windows come out when they are final."""
    return events.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def append_validated(stream: DataFrame, validate: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, trigger: str = "500 milliseconds", once: bool = False) -> StreamingQuery:
    """Each batch is validated as a whole before it is appended; the checkpoint is what has been committed. validate gives the rows that are wrong: one of them fails the batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            wrong = validate(batch).limit(1).collect()
            if wrong:
                raise ValueError(f"batch {number}: {wrong[0]}")
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a batch that is run again replaces its own folder
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=trigger)).start()
