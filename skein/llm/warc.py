"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

An archive is a file of gzip members, one per record. The reader's tasks get byte ranges. A task scans its range for gzip's magic bytes, tries each candidate by decoding a member from it
and checking the WARC header, and follows the chain of members from there; it owns the records that start inside its range, the last of which may end behind it.
A candidate whose chain breaks before CONFIRM_BYTES behind the range's end, or the file's end (bytes of a payload may look like a member, or even be one), is dropped and the scan goes on behind it. What stays possible: that a
payload holds, uncompressed, an archive that crosses a range's end and goes on for CONFIRM_BYTES more.

Files are read and written by pyarrow's file systems, so that a path can be local, on a shared mount or in an object store.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm._shared import lean, salted_left_join, shared_dir

SPLIT_BYTES = 4 << 20
FILE_BYTES = 64 << 20
CONFIRM_BYTES = 64 << 10
BATCH_BYTES, TASKS = 4 << 20, 100_000
_MAGIC = b"\x1f\x8b\x08"
_BLOCK = 1 << 18
_REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_SCHEMA = "path string, offset bigint, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary, digest_ok boolean"


def _filesystem(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file:///" + path[6:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, record_id: str, uri: str, refers_to: str | None, payload: bytes, level: int) -> bytes:
    """One gzip member. A revisit keeps the HTTP header, with the length of the payload, and not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    uri = uri.replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {_REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES, level: int = 4) -> DataFrame:
    """Write page_id, url, html of each row as a record; gives the table of files: path, bytes, records.

    Of the rows whose payload (html in UTF-8, null: empty) is equal and has at least least_bytes bytes, that with the smallest page_id is a response and others are revisits of it; rows with that same page_id are
    responses too. Smaller payloads, and payloads whose rows have no page_id at all, are responses. A row without page_id that repeats another's payload is a revisit. A null url is empty.
    Other columns have no part in it, whatever their names. A task that is run again writes files of new names; only those of the attempt that counts are in the table, which is stored in `folder` too.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("__same", F.unhex(F.sha2("html", 256)))
    repeated = rows.where(F.octet_length("html") >= least_bytes).groupBy("__same").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and first_id is not null").drop("n")
    rows = salted_left_join(rows, repeated, "__same", F.xxhash64("page_id", "url")).select("page_id", "url", "html", "first_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = _filesystem(folder)
        fs.create_dir(place, recursive=True)
        out, name, size, n = None, "", 0, 0

        def done():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{name}"]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=["path", "bytes", "records"])

        for batch in batches:
            for page_id, url, html, first_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, size, n = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{place.rstrip('/')}/{name}", compression=None)
                again = first_id is not None and page_id != first_id
                record = _record("revisit" if again else "response", f"urn:page:{'none' if page_id is None else page_id}", url, f"urn:page:{first_id}", html.encode(), level)
                out.write(record)
                size, n = size + len(record), n + 1
                if size >= file_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    files = rows.mapInArrow(lean(write), "path string, bytes bigint, records bigint")
    files.write.mode("errorifexists").parquet(f"{folder.rstrip('/')}/_files")
    return pages.sparkSession.read.schema("path string, bytes bigint, records bigint").parquet(f"{folder.rstrip('/')}/_files")


def files_in(spark: SparkSession, pattern: str) -> DataFrame:
    """path and bytes of the archives that match a path pattern, listed by Spark; their content isn't read."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes"))


class _File:
    """A file read forward in blocks, with a step back as far as the last candidate."""

    def __init__(self, path: str, size: int):
        fs, place = _filesystem(path)
        self.file, self.size, self.start, self.data = fs.open_input_file(place), size, 0, b""

    def at(self, pos: int, least: int = 1) -> memoryview:
        """Bytes from pos on, at least so many unless the file ends."""
        if not self.start <= pos or pos + least > self.start + len(self.data):
            if self.start <= pos <= self.start + len(self.data):
                have = self.data[pos - self.start :]
            else:
                have = b""
            self.file.seek(pos + len(have))
            self.data, self.start = have + self.file.read(max(_BLOCK, least - len(have))), pos
        return memoryview(self.data)[pos - self.start :]

    def member(self, pos: int) -> tuple[bytes, int] | None:
        """The decoded member that starts at pos and the place behind it; None if there is none or it isn't a WARC record."""
        if self.at(pos, 3)[:3] != _MAGIC:
            return None
        unpack, out, head, p = zlib.decompressobj(31), [], b"", pos
        try:
            while not unpack.eof:
                block = bytes(self.at(p)[:_BLOCK])
                if not block:
                    return None
                got = unpack.decompress(block)
                p += len(block) - len(unpack.unused_data)
                out.append(got)
                if len(head) < 5:
                    head += got[:5]
                    if head != b"WARC/"[: len(head)]:
                        return None
        except zlib.error:
            return None
        return b"".join(out), p


def _parsed(raw: bytes) -> dict | None:
    """The fields of a record; None if its header isn't sound."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    if not found:
        return None
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, colon, value = line.partition(":")
        if colon:
            fields[key.strip().lower()] = value.strip()
    if "warc-type" not in fields or not fields.get("content-length", "").isdigit():
        return None
    length = int(fields["content-length"])
    if len(rest) < length:
        return None
    block, kind = rest[:length], fields["warc-type"]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    payload, size = None, None
    if fields.get("content-type", "").startswith("application/http"):
        http, _, body = block.partition(b"\r\n\r\n")
        size = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:]) if k.strip().lower() == b"content-length" and v.strip().isdigit()), None)
        payload = None if kind == "revisit" else body
    elif kind != "revisit":
        payload = block
    return {
        "record_type": kind,
        "record_id": fields.get("warc-record-id", "").strip("<>") or None,
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to", "").strip("<>") or None,
        "payload_digest": digest,
        "payload_bytes": len(payload) if payload is not None else size,
        "payload": payload,
        "digest_ok": None if payload is None or digest is None else base32_sha1(payload) == digest,
    }


def _start(file: _File, start: int, end: int) -> int | None:
    """Where the first record that starts in start to end does; None if none does."""
    if not start:
        return 0 if file.member(0) else _start(file, 1, end)
    pos = start
    while pos < end:
        view = file.at(pos, 3)
        if len(view) < 3:
            return None
        hit = bytes(view).find(_MAGIC)
        if hit < 0:
            pos += max(1, len(view) - 2)
            continue
        pos += hit
        if pos >= end:
            return None
        p = pos
        while p < min(file.size, end + CONFIRM_BYTES):  # what starts behind the end are other ranges' records; they confirm the chain
            got = file.member(p)
            if not got or not _parsed(got[0]):
                break
            p = got[1]
        else:
            return pos
        pos += 1
    return None


def _owned(path: str, size: int, start: int, end: int) -> Iterator[dict]:
    """The records that start in start to end, one after the other."""
    file = _File(path, size)
    pos = _start(file, start, end)
    while pos is not None and pos < end:
        got = file.member(pos)
        fields = got and _parsed(got[0])
        if not fields:  # of a damaged file: what follows is looked for anew
            pos = _start(file, pos + 1, end)
            continue
        yield {"path": path, "offset": pos, **fields}
        pos = got[1]


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per record of the files (path, bytes): path, offset, record_type, record_id, target_uri, refers_to, payload_digest, payload_bytes, payload and digest_ok.

    payload and digest_ok are null for revisits; payload_bytes is then what the kept HTTP header says. Null and negative sizes are no files. Other columns of files are left out, whatever their names. Tasks hold BATCH_BYTES
    of decoded records, or one record that is larger. There are as many tasks as ranges, up to TASKS; then each reads several.
    """
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(split_bytes).cast("bigint"))).alias("first"))
    tasks = files.where("bytes > 0").agg(F.coalesce(F.sum(F.ceil(F.col("bytes") / split_bytes)), F.lit(1))).first()[0]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"offset": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary(), "digest_ok": pa.bool_()}
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        held: list[dict] = []

        def flush():
            rows = [pa.array([r[n] for r in held], kinds.get(n, pa.string())) for n in names]
            held.clear()
            return pa.RecordBatch.from_arrays(rows, names=names)

        for batch in batches:
            for path, size, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                waiting = 0
                for record in _owned(path, size, first, min(size, first + split_bytes)):
                    held.append(record)
                    waiting += len(record["payload"] or b"") + 500
                    if waiting > BATCH_BYTES:
                        yield flush()
                        waiting = 0
                if held:
                    yield flush()

    return ranges.repartition(int(min(TASKS, tasks)), "path", "first").mapInArrow(lean(read), _SCHEMA)


def digest(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from the archives written."""
    files = write_archives(pages, f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}")
    back = read_archives(files)
    return back.select(
        F.expr("try_cast(regexp_extract(record_id, '^urn:page:(-?[0-9]+)$', 1) as bigint)").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.expr("try_cast(regexp_extract(refers_to, '^urn:page:(-?[0-9]+)$', 1) as bigint)").alias("refers_to"),
    )


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages),
d AS (SELECT *, list_aggregate(list_transform(string_split(upper(sha1(html)), ''), lambda x: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789ABCDEF', x)]), 'string_agg', '') AS bits FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, i * 5 + j + 1, 1) AS INTEGER) * CAST(pow(2, 4 - j) AS INTEGER)))::INTEGER, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""
