"""A sink of JSON lines for streams, as a Data Source: tasks buffer rows, flush them by number or age to files of their own, and a batch's files count when its commit file names them.

A batch that is run again finds its commit file and adds nothing; files of tasks that failed or lost are named by no commit. The folder is one that the driver and all executors see (a URI of any store that Arrow opens).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType

ROWS, MILLISECONDS = 32, 500


@dataclass
class _Written(WriterCommitMessage):
    """A task's file, empty if it had no rows, with its rows, flushes and bytes."""

    file: str
    rows: int
    flushes: int
    bytes: int


def _store(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def line(row: Row) -> bytes:
    """A row as one line of canonical JSON: keys in order, no blanks, no numbers that JSON lacks."""
    return json.dumps(row.asDict(recursive=True), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False, default=str).encode() + b"\n"


class _Writer(DataSourceStreamWriter):
    def __init__(self, path: str, rows: int, milliseconds: int) -> None:
        self.path, self.rows, self.milliseconds = path, rows, milliseconds

    def write(self, iterator: Iterator[Row]) -> _Written:
        store, top = _store(self.path)
        name, out = f"rows-{uuid.uuid4().hex}.jsonl", _Written("", 0, 0, 0)
        held, since, file = [], time.monotonic(), None
        try:
            for row in iterator:
                held.append(line(row))
                if len(held) >= self.rows or (time.monotonic() - since) * 1000 >= self.milliseconds:
                    file = file or self._opened(store, top, name)
                    self._flush(file, held, out)
                    held, since = [], time.monotonic()
            if held:
                file = file or self._opened(store, top, name)
                self._flush(file, held, out)
        finally:
            if file:
                file.close()
        out.file = name if file else ""
        return out

    @staticmethod
    def _opened(store, top: str, name: str):
        store.create_dir(f"{top}/data", recursive=True)
        return store.open_output_stream(f"{top}/data/{name}")

    @staticmethod
    def _flush(file, held: list[bytes], out: _Written) -> None:
        raw = b"".join(held)
        file.write(raw)
        file.flush()
        out.rows, out.flushes, out.bytes = out.rows + len(held), out.flushes + 1, out.bytes + len(raw)

    def commit(self, messages: list[_Written | None], batchId: int) -> None:
        from pyarrow import fs

        store, top = _store(self.path)
        name = f"{top}/commits/batch-{batchId:012d}.json"
        if store.get_file_info(name).type == fs.FileType.File:
            self.abort(messages, batchId)  # this batch has been committed before: what it wrote now isn't needed
            return
        store.create_dir(f"{top}/commits", recursive=True)
        rows = [json.dumps({"batch": batchId, "file": m.file, "rows": m.rows, "flushes": m.flushes, "bytes": m.bytes}) for m in messages if m and m.file] or [json.dumps({"batch": batchId, "file": "", "rows": 0, "flushes": 0, "bytes": 0})]
        staged = f"{top}/commits/.{uuid.uuid4().hex}"  # names with a dot are not read
        with store.open_output_stream(staged) as file:
            file.write(("\n".join(rows) + "\n").encode())
        store.move(staged, name)

    def abort(self, messages: list[_Written | None], batchId: int) -> None:
        store, top = _store(self.path)
        for m in messages:
            if m and m.file:
                try:
                    store.delete_file(f"{top}/data/{m.file}")
                except FileNotFoundError:
                    pass


class BufferedLines(DataSource):
    """writeStream.format("buffered_lines").option("path", ...), with the options rows and milliseconds."""

    @classmethod
    def name(cls) -> str:
        return "buffered_lines"

    def streamWriter(self, schema: StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("lines are only added")
        return _Writer(self.options["path"], int(self.options.get("rows", ROWS)), int(self.options.get("milliseconds", MILLISECONDS)))


def append(stream: DataFrame, path: str, checkpoint: str, rows: int = ROWS, milliseconds: int = MILLISECONDS):
    """A writer of the stream's rows to path, to be started; the trigger is the caller's."""
    stream.sparkSession.dataSource.register(BufferedLines)
    return stream.writeStream.format("buffered_lines").option("path", path).option("rows", rows).option("milliseconds", milliseconds).option("checkpointLocation", checkpoint)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """batch, file, rows, flushes and bytes of what is committed."""
    schema = "batch bigint, file string, rows bigint, flushes bigint, bytes bigint"
    try:
        return spark.read.schema(schema).json(f"{path.rstrip('/')}/commits")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The committed rows. Files are named by the commits, of which there are as many as tasks wrote."""
    files = [r["file"] for r in commits(spark, path).where(F.col("file") != "").select("file").collect()]
    return spark.read.schema(schema).json([f"{path.rstrip('/')}/data/{f}" for f in files]) if files else spark.createDataFrame([], schema)
