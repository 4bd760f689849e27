"""Files and folders below a root, listed by Spark: each round's tasks list the folders that the round before found.

A round's rows are stored before the next one reads them, so that a lost task lists its own folders again and no others. A folder is listed by one task, which streams its entries out in batches; nothing comes to the driver but counts.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.shared import shared_dir

# fixed values: names that no listing shows, in any case of their letters
PROTECTED_FOLDERS = (".git", ".worktrees", ".agent", ".rag", "runtime_data")
PROTECTED_FILES = (".env", ".git-credentials", ".netrc", "_netrc", ".npmrc", ".pypirc")
PROTECTED_STARTS = (".env.", ".agent-tmp-")
ALLOWED_FILES = (".env.example",)
MOST_RESULTS, MOST_ENTRIES = 200, 2000

_ROW = "path string, directory boolean, bytes bigint, omitted boolean"
_BATCH = 4096


class Listing(NamedTuple):
    """entries: path, directory, bytes in the order of paths. omitted: how many other entries were met. reason: what cut the list short (entry_budget, max_results), or None. after: the path to go on from, or None."""

    entries: DataFrame
    omitted: int
    reason: str | None
    after: str | None


def path_error(path: str) -> str | None:
    """Why a path isn't one below a root: empty, long (4,096 bytes, 255 a name), not UTF-8, absolute, with a backslash, or with an empty name, "." or ".."."""
    try:
        raw = path.encode()
    except UnicodeEncodeError:
        return "encoding"
    if not raw or len(raw) > 4096 or any(len(name) > 255 for name in raw.split(b"/")):
        return "length"
    if "\\" in path or path.startswith("/") or (path[1:2] == ":" and path[0].isascii() and path[0].isalpha()):
        return "absolute"
    return "name" if any(name in ("", ".", "..") for name in path.split("/")) else None


def protected(path: Column) -> Column:
    """Whether a path is in a folder, or is a file, that listings leave out."""
    names = F.split(F.lower(path), "/")
    leaf = F.element_at(names, -1)
    starts = F.lit(False)
    for start in PROTECTED_STARTS:
        starts |= leaf.startswith(start)
    return F.arrays_overlap(names, F.array(*map(F.lit, PROTECTED_FOLDERS))) | leaf.isin(*PROTECTED_FILES) | (starts & ~leaf.isin(*ALLOWED_FILES))


def _local(folder: str) -> Iterator[tuple[str, bool | None, int]]:
    """Name, whether it is a folder (None: neither folder nor file, as links are), and bytes."""
    with os.scandir(folder) as entries:
        for e in entries:
            if e.is_dir(follow_symlinks=False):
                yield e.name, True, 0
            elif e.is_file(follow_symlinks=False):
                yield e.name, False, e.stat(follow_symlinks=False).st_size
            else:
                yield e.name, None, 0


def _remote(folder: str) -> Iterator[tuple[str, bool | None, int]]:
    from pyarrow import fs

    store, top = fs.FileSystem.from_uri(folder)
    for e in store.get_file_info(fs.FileSelector(top)):
        kind = {fs.FileType.Directory: True, fs.FileType.File: False}.get(e.type)
        yield e.base_name, kind, e.size if kind is False else 0


def _rows(root: str, folders: Iterable[str]) -> Iterator[tuple[str, bool, int, bool]]:
    base = "/" + root.removeprefix("file:").lstrip("/") if root.startswith(("/", "file:")) else root.rstrip("/")
    listed = _local if base.startswith("/") else _remote
    for folder in folders:
        for name, directory, size in listed(f"{base}/{folder}".rstrip("/") or "/"):
            path = f"{folder}/{name}" if folder else name
            sound = directory is not None and path_error(path) is None
            yield path.encode("utf-8", "replace").decode(), bool(directory), size, not sound


def _listed(folders: DataFrame, root: str) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = _rows(root, (f for batch in batches for f in batch["folder"]))
        while some := list(islice(rows, _BATCH)):
            yield pd.DataFrame(some, columns=["path", "directory", "bytes", "omitted"])

    spread = folders.repartition(folders.sparkSession.sparkContext.defaultParallelism, "folder")
    return spread.mapInPandas(work, _ROW).withColumn("omitted", F.col("omitted") | protected(F.col("path")))


def walk(spark: SparkSession, root: str, path: str = "", recursive: bool = True, most: int | None = None) -> tuple[DataFrame, bool]:
    """path, directory, bytes and omitted of all entries below root/path, as a stored table, and whether `most` cut it short.

    With most, so many entries are taken, those of upper folders first and of equal depth in the order of paths, and no folder is opened once they are reached. Omitted are links and other kinds, paths that aren't sound (a byte that isn't
    UTF-8 is a question mark) and protected ones; omitted folders aren't opened. A folder that is missing, or can't be read, is an error; an empty one gives no rows.
    """
    if path and (error := path_error(path)):
        raise ValueError(f"the path can't be listed: {error}")
    if path and spark.range(1).select(protected(F.lit(path))).first()[0]:
        raise ValueError("the path can't be listed: protected")
    place = f"{shared_dir(spark)}/listing-{uuid.uuid4().hex}"
    left, cut, depth = most, False, 0
    folders = spark.createDataFrame([(path,)], "folder string")
    while True:
        raw, out = f"{place}/raw/{depth}", f"{place}/level/depth={depth}"
        _listed(folders, root).write.parquet(out if left is None else raw)
        if left is not None:
            level = spark.read.schema(_ROW).parquet(raw)
            n = level.count()
            cut = n > left
            (level.orderBy("path").limit(left) if cut else level).write.parquet(out)
            left -= min(n, left)
        folders = spark.read.schema(_ROW).parquet(out).where("directory and not omitted").select(F.col("path").alias("folder"))
        depth += 1
        if cut or not recursive or folders.isEmpty():
            break
    return spark.read.schema(_ROW).parquet(*(f"{place}/level/depth={d}" for d in range(depth))), cut


def list_files(spark: SparkSession, root: str, path: str = "", recursive: bool = False, max_results: int = MOST_RESULTS, max_entries: int | None = MOST_ENTRIES, after: str | None = None) -> Listing:
    """One page of the entries below root/path, by the bytes of their paths: at most max_results, of those the ones behind `after`. max_entries bounds the entries that are met at all."""
    if not 1 <= max_results <= MOST_RESULTS:
        raise ValueError(f"max_results is between 1 and {MOST_RESULTS}")
    rows, cut = walk(spark, root, path, recursive, max_entries)
    return page(rows, cut, max_results, after)


def page(rows: DataFrame, cut: bool = False, max_results: int = MOST_RESULTS, after: str | None = None) -> Listing:
    """A page of walk()'s table; further ones need no new walk."""
    sound = rows.where(~F.col("omitted")).select("path", "directory", "bytes")
    found = (sound if after is None else sound.where(F.col("path") > after)).orderBy("path").limit(max_results + 1).collect()  # at most 201
    more = len(found) > max_results
    found = found[:max_results]
    entries = rows.sparkSession.createDataFrame(found, "path string, directory boolean, bytes bigint")
    return Listing(entries, rows.where("omitted").count(), "entry_budget" if cut else "max_results" if more else None, found[-1]["path"] if more else None)
