"""A corpus as files, one for each document, that appear together: downloads joined to titles and checked, files written to a folder of their own, and a manifest that makes them the last version of the corpus.

Until the manifest is published (sources.versions) nobody sees the files, so that a lost task just writes its files again, and a failed build leaves the corpus that was there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import checks, corpus
from skein.sources import versions

DOWNLOAD = "url string, relative_path string, bytes bigint, sha256 string, etag string, last_modified string, retrieved_utc string, disposition string"


def title_downloads(titles: DataFrame, downloads: DataFrame, url: str, path: str = "raw/title-%03d.xml") -> DataFrame:
    """number, name, relative_path, url, sha256, retrieved_utc and error for each title (number, name, reserved) that isn't reserved: repeated (title or download), missing, or a download whose url, digest or time isn't right.

    url and path are formats with the title's number.
    """
    own = titles.where(~F.col("reserved")).groupBy("number").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("__titles"))
    got = downloads.groupBy("relative_path").agg(F.count(F.lit(1)).alias("__downloads"), *(F.min(c).alias(c) for c in ("url", "sha256", "retrieved_utc")))
    rows = own.withColumn("relative_path", F.format_string(path, "number")).join(got, "relative_path", "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    error = (
        F.when((F.col("__titles") > 1) | (F.col("__downloads") > 1), "repeated")
        .when(F.col("__downloads").isNull(), "missing")
        .when(no(F.col("url") == F.format_string(url, "number")), "url")
        .when(no(F.col("sha256").rlike("^[0-9a-f]{64}$")), "digest")
        .when(no(F.col("retrieved_utc").endswith("Z")), "time")
    )
    return rows.select("number", "name", "relative_path", "url", "sha256", "retrieved_utc", error.alias("error"))


def assert_complete(joined: DataFrame, expected: int) -> None:
    """Rows of title_downloads() without an error, as many as are expected."""
    checks.assert_none(joined.where("error is not null").select("number", "error"), "a title's download is wrong")
    checks.assert_none(joined.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected), f"there should be {expected} titles")


def _put(place: str):
    """Write each row's text to its path below place."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(place)
        made: set[str] = set()
        for batch in batches:
            sizes, digests = [], []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw, folder = text.encode(), f"{top}/{path}".rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{top}/{path}") as file:
                    file.write(raw)
                sizes.append(len(raw))
                digests.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["text"]).columns, pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], [*(n for n in batch.schema.names if n != "text"), "bytes", "sha256"])

    return put


def _uri(path: str) -> str:
    return path if "://" in path else f"file:{path}" if path.startswith("file:") else f"file://{path}" if path.startswith("/") else path


def write_corpus(docs: DataFrame, root: str, count: int | None = None) -> int:
    """Publish documents (citation, path, text, body_bytes, body_sha256 and others) as files; gives the version. With count, the largest ones, ties by citation and digest, and fewer are an error.

    A citation with different documents, a path of two documents or one that leaves the folder is an error; a citation that is repeated as it is counts once. Rows of the manifest: all columns but the text, with the file's bytes and sha256.
    """
    spark = docs.sparkSession
    number = versions.latest(spark, root) + 1
    place = versions.folder(root, number)
    payload = [c for c in docs.columns if c != "citation"]
    checks.assert_none(corpus.dedupe_conflicts(docs, "citation", *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in payload)).where("conflict").select("citation"), "a citation has different documents")
    once = docs.dropDuplicates(["citation"])
    chosen = once if count is None else corpus.select_documents(once, count, "body_bytes", "citation", "body_sha256")
    checks.assert_none(chosen.groupBy("path").count().where("count > 1").select("path"), "a path has two documents")
    checks.assert_none(chosen.where(F.col("path").isNull() | F.col("path").rlike(r"^/|(^|/)\.{0,2}(/|$)|[\\\x00-\x1F]") | F.col("text").isNull()).select("path"), "a path or text can't be a file")
    rest = [c for c in chosen.columns if c not in ("text", "bytes", "sha256")]
    schema = ", ".join(f"`{c}` {dict(chosen.dtypes)[c]}" for c in rest) + ", bytes bigint, sha256 string"
    chosen.select(*rest, "text").mapInArrow(_put(_uri(f"{place}/files")), schema).write.parquet(f"{place}/manifest")
    n = spark.read.parquet(f"{place}/manifest").count()
    checks.assert_none(spark.range(1).where(F.lit(count is not None and n != count)), f"there are {n} complete documents of {count}")
    report = spark.createDataFrame([(2, once.count(), n)], "schema_version int, candidates bigint, selected bigint")
    report.coalesce(1).write.json(f"{place}/report")
    versions.publish(spark, root, number, [versions.Piece("manifest", -1, number, n, None, f"{place}/manifest"), versions.Piece("files", -1, number, n, None, f"{place}/files"), versions.Piece("report", -1, number, 1, None, f"{place}/report")])
    return number


def _paths(spark: SparkSession, root: str, version: int | None) -> dict[str, str]:
    return {p.name: p.path for p in versions.pieces(spark, root, version)[1]}


def files_folder(spark: SparkSession, root: str, version: int | None = None) -> str:
    """The folder of the published files."""
    return _paths(spark, root, version)["files"]


def read_manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The published documents' rows, with the whole path of each file."""
    where = _paths(spark, root, version)
    return spark.read.parquet(where["manifest"]).withColumn("file", F.concat(F.lit(f"{where['files']}/"), "path"))


def verify_corpus(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """path and state (ok, missing, unlisted, bytes or digest) of each file that is listed or there."""
    where = _paths(spark, root, version)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(where["files"])
    found = found.select(F.element_at(F.split("path", "/files/"), -1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return checks.verify_files(spark.read.parquet(where["manifest"]).select("path", "bytes", "sha256"), found, "path", "bytes", "sha256")
