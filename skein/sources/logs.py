"""JSON-lines logs, strictly read."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators.checks import assert_none


def read_jsonl(spark: SparkSession, path: str, schema: str, blank_lines: bool = False, strict: bool = True) -> DataFrame:
    """Rows of JSON lines with a fixed schema. A line that isn't one object with exactly the schema's keys, each once, fails the read; with strict=False it is a row with the line in _error. Blank lines are allowed or are errors."""
    lines = spark.read.text(path)
    if blank_lines:
        lines = lines.where(F.trim("value") != "")
    fields = [x.strip().split()[0] for x in schema.split(",")]
    sound = F.try_parse_json("value").isNotNull() & (F.array_sort(F.json_object_keys("value")) == F.array(*map(F.lit, sorted(fields))))
    rows = lines.withColumn("_error", F.when(F.coalesce(sound, F.lit(False)), None).otherwise(F.col("value")))
    if strict:
        assert_none(rows.where("_error is not null").select("_error"), "a line breaks the schema")
        return rows.select(F.from_json("value", schema).alias("r")).select("r.*")
    return rows.select(F.from_json(F.when(F.col("_error").isNull(), F.col("value")), schema).alias("r"), "_error").select("r.*", "_error")


def truncated_files(spark: SparkSession, path: str) -> DataFrame:
    """path of each file whose last byte isn't a line feed: its last line was not written whole. Spark lists the files, but for empty ones; a task reads one byte of each."""

    def last_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            wrong = []
            for name, size in batch.itertuples(index=False):
                store, place = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
                with store.open_input_file(place) as file:
                    file.seek(size - 1)
                    if file.read(1) != b"\n":
                        wrong.append(name)
            yield pd.DataFrame({"path": pd.Series(wrong, dtype=object)})

    return spark.read.format("binaryFile").load(path).select("path", "length").mapInPandas(last_bytes, "path string")


def read_log(spark: SparkSession, path: str, schema: str, kind: str) -> DataFrame:
    """Events of logs by each kind's rules. Blank lines are left out of task logs, and are errors in session and memory logs, whose files also have to end with a line feed and to have a line (an empty file among others isn't seen). Lines that break the schema, or hold a key twice, are errors in all."""
    if kind not in ("task", "session", "memory"):
        raise ValueError("the kind is task, session or memory")
    if kind != "task":
        assert_none(truncated_files(spark, path), "a log is truncated")
        if spark.read.text(path).isEmpty():
            raise ValueError("a log is truncated: there is no event")
    return read_jsonl(spark, path, schema, blank_lines=kind == "task")


def sequence_errors(events: DataFrame, key: str, sequence: str = "sequence") -> DataFrame:
    """Events whose number isn't one more than the one before, from 1 on."""
    before = F.lag(sequence).over(Window.partitionBy(key).orderBy(sequence))
    return events.withColumn("expected", F.coalesce(before + 1, F.lit(1))).where(F.col(sequence) != F.col("expected"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """path, heading, body, body_start_line and body_sha256 of Markdown files with front matter."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"\r\n?", "\n").alias("v"))
    rest = F.expr("substring(v, instr(v, '\\n---\\n\\n') + 6)")
    files = files.where(F.startswith("v", F.lit("---\n"))).withColumn("rest", rest).withColumn("skip", F.instr("rest", "\n\n"))
    body = F.regexp_replace(F.expr("substring(rest, skip + 2)"), r"\n\z", "")
    head = F.expr("substring(v, 1, length(v) - length(rest) + skip + 1)")
    return files.select("path", F.regexp_replace(F.expr("substring(rest, 1, skip - 1)"), "^# ", "").alias("heading"), body.alias("body"), (1 + F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))).alias("body_start_line"), F.sha2(body, 256).alias("body_sha256"))
