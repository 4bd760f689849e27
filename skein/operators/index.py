"""A stored index of chunks that is brought up to date: chunks, postings in ranges of terms, document frequencies, vectors and one row about the whole.

A full build writes each table once, in a base. An upgrade compares the corpus with the chunks of the last version, and adds only what has changed: rows of chunks and vectors that replace older ones, and signed rows of postings (the
old content's taken off, the new one's put on) and of frequencies, which are summed when the index is read. Ranges of terms that nothing has changed in are read as they are. Compaction rewrites the ranges, and the tables, whose additions have grown beyond a
share of their base. Every build, upgrade and compaction is a version of its own (sources.versions), checked before it is published; readers of older ones go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import checks, search
from skein.operators.order import numbered
from skein.sources import versions
from skein.sources.shared import dropping_shuffles, stored
from skein.sources.versions import Piece

#: Columns of a chunk; vectors are (chunk_id, embedding, embedding_sha256).
CHUNK = ("chunk_id", "document_id", "citation", "content", "sha256", "token_count", "previous_id", "next_id")
_POSTING = "term string, chunk_id string, tf bigint, length bigint"
#: Kinds of changes of a chunk; a moved one has the same content.
CHANGES = ("added", "changed", "moved", "removed")


@dataclass(frozen=True)
class Index:
    """postings: term, chunk_id, tf, length (the chunk's tokens); terms: term, df; stats: n, sum_token_count, average, dimensions, model.

    signed: the rows that postings are merged from. For sums of tf and length they do as well, without meeting by chunk first: what has been taken off is there with a minus.
    """

    chunks: DataFrame
    postings: DataFrame
    terms: DataFrame
    vectors: DataFrame
    stats: DataFrame
    version: int
    signed: DataFrame


def chunk_errors(chunks: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """chunk_id and error of each chunk that is empty, has another digest than its content's, no tokens, an id that isn't its own alone, or a neighbour that isn't there (in known, all chunks if only some are judged), is of another document or doesn't look back."""
    known = (chunks if known is None else known).select(F.col("chunk_id").alias("other"), F.col("document_id").alias("other_document"), F.col("previous_id").alias("other_previous"), F.col("next_id").alias("other_next"))
    own = F.when(F.coalesce(F.col("content"), F.lit("")) == "", "empty").when(F.sha2("content", 256) != F.col("sha256"), "digest").when(F.coalesce(F.col("token_count"), F.lit(0)) < 1, "tokens")
    rows = chunks.select("chunk_id", own.alias("error")).where("error is not null")
    twice = chunks.groupBy("chunk_id").count().where("count > 1").select("chunk_id", F.lit("repeated").alias("error"))

    def broken(link: str, back: str) -> DataFrame:
        linked = chunks.where(F.col(link).isNotNull()).join(known, F.col(link) == F.col("other"), "left")
        wrong = F.col("other").isNull() | (F.col("other_document") != F.col("document_id")) | ~F.col(back).eqNullSafe(F.col("chunk_id"))
        return linked.where(wrong).select("chunk_id", F.lit("neighbor").alias("error"))

    return rows.unionByName(twice).unionByName(broken("next_id", "other_previous")).unionByName(broken("previous_id", "other_next"))


def identity(*parts: Column) -> Column:
    """What vectors depend on (model, revision, dimensions, tokenizer, backend, precision) as one digest: vectors of another one aren't reused."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def to_encode(chunks: DataFrame, old: DataFrame, text_sha256: str) -> tuple[DataFrame, DataFrame]:
    """Vectors of old (chunk_id, embedding, embedding_sha256, identity) that chunks (with identity) can keep, and the chunks without: those whose text or identity has changed."""
    keys = [F.col("chunk_id"), F.col(text_sha256).alias("embedding_sha256"), F.col("identity")]
    names = ["chunk_id", "embedding_sha256", "identity"]
    return old.join(chunks.select(*keys), names, "left_semi"), chunks.join(old.select("chunk_id", F.col("embedding_sha256").alias(text_sha256), "identity"), ["chunk_id", text_sha256, "identity"], "left_anti")


def _postings(chunks: DataFrame) -> DataFrame:
    return search.postings(chunks.withColumn("token_count", F.col("token_count").cast("bigint")), "chunk_id", "content", "token_count").select("term", "chunk_id", "tf", F.col("token_count").alias("length"))


def _key(term: str = "term", chunk: str = "chunk_id") -> Column:
    """Terms have no NUL, so that keys stand in the order of (term, chunk_id)."""
    return F.concat(F.col(term), F.lit("\0"), F.col(chunk))


def _put(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    with dropping_shuffles(spark):
        rows.write.mode("errorifexists").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _put_parts(rows: DataFrame, spark: SparkSession, name: str, level: int, path: str, lows: dict[int, str] | None = None) -> list[Piece]:
    """Write rows, which have a part, sorted, a folder for each part. There are as many parts as the build has ranges."""
    with dropping_shuffles(spark):
        rows.sortWithinPartitions("part", "term", "chunk_id").select("part", "term", "chunk_id", "tf", "length").write.partitionBy("part").mode("errorifexists").parquet(path)
    rows = spark.read.schema(f"part int, {_POSTING}").parquet(path)
    first = {} if lows is not None else dict(rows.where("_metadata.row_index = 0").groupBy("part").agg(F.min(_key())).collect())  # files are sorted: a part's least key is the first one of a file
    return [Piece(name, part, level, n, first.get(part) if lows is None else lows.get(part), f"{path}/part={part}") for part, n in rows.groupBy("part").count().collect()]


def _vector_errors(vectors: DataFrame, dimensions: int | None = None) -> DataFrame:
    """Vectors without a length or with what isn't finite, or of another number of dimensions than is given, or than the first one's."""
    size = F.size("embedding")
    wrong = search.normalized(F.col("embedding")).isNull()
    if dimensions is not None:
        return vectors.where(wrong | (size != dimensions)).select("chunk_id")
    sizes = vectors.agg(F.min(size).alias("least"), F.max(size).alias("most"))
    return vectors.where(wrong).select("chunk_id").unionByName(sizes.where("least <> most or least < 1").select(F.lit("dimensions").alias("chunk_id")))


def _assert_sound(wrong: dict[str, DataFrame]) -> None:
    for what, rows in wrong.items():
        checks.assert_none(rows, what)


def write(chunks: DataFrame, vectors: DataFrame, path: str, model: str = "given", ranges: int | None = None) -> int:
    """Build, check and publish the whole index; gives the version. A chunk without a vector, or the other way round, is an error, as are all of chunk_errors().

    Texts are tokenized once. ranges: how many ranges of (term, chunk_id) postings are dealt to, so that a common word's may be in several; the session's number of shuffle partitions unless given.
    """
    spark = chunks.sparkSession
    number = versions.latest(spark, path) + 1
    place = versions.folder(path, number)
    chunks = _put(chunks.select(*CHUNK), spark, f"{place}/chunks")
    vectors = _put(vectors, spark, f"{place}/vectors")
    ids, have = chunks.select("chunk_id"), vectors.select("chunk_id")
    _assert_sound({
        "a chunk is wrong": chunk_errors(chunks),
        "chunks and vectors differ": ids.join(have, "chunk_id", "left_anti").union(have.join(ids, "chunk_id", "left_anti")),
        "a vector isn't finite, or has another length": _vector_errors(vectors),
    })
    found = stored(_postings(chunks), "postings")  # the ranges are sampled from these before they are dealt
    dealt = found.repartitionByRange(ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), "term", "chunk_id").withColumn("part", F.spark_partition_id())
    parts = _put_parts(dealt, spark, "postings", number, f"{place}/postings")
    terms = _put(search.document_frequency(found).repartitionByRange("term").sortWithinPartitions("term"), spark, f"{place}/terms")
    dimensions = vectors.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimensions"))
    _put(search.index_stats(chunks, "token_count").join(F.broadcast(dimensions)).withColumn("model", F.lit(model)), spark, f"{place}/stats")
    rows = chunks.count()
    whole = [("chunks", rows), ("vectors", rows), ("terms", terms.count()), ("stats", 1)]
    versions.publish(spark, path, number, [*(Piece(name, -1, number, n, None, f"{place}/{name}") for name, n in whole), *parts])
    return number


def _named(found: list[Piece], name: str) -> list[Piece]:
    return sorted((p for p in found if p.name == name), key=lambda p: (p.level, p.part))


def _rows(spark: SparkSession, found: list[Piece], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*(p.path for p in found)) if found else spark.createDataFrame([], schema)


def _newest(spark: SparkSession, found: list[Piece], name: str) -> DataFrame:
    """A table whose later rows replace those with their chunk_id; rows that are gone only take off."""
    (base,) = _named(found, name)
    rows, added = spark.read.parquet(base.path), None
    for p in _named(found, f"{name}+"):
        more = spark.read.parquet(p.path).withColumn("__level", F.lit(p.level))
        added = more if added is None else added.unionByName(more)
    if added is None:
        return rows
    last = added.groupBy("chunk_id").agg(F.max_by(F.struct("*"), "__level").alias("r")).select("r.*")
    return rows.join(last.select("chunk_id"), "chunk_id", "left_anti").unionByName(last.where("not gone").drop("gone", "__level"))


def _summed(rows: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*(F.sum(c).alias(c) for c in sums))


def _open(spark: SparkSession, number: int, found: list[Piece]) -> Index:
    added = {p.part for p in _named(found, "postings+")}
    still = _rows(spark, [p for p in _named(found, "postings") if p.part not in added], _POSTING)
    postings = still
    if added:
        moved = _rows(spark, [*(p for p in _named(found, "postings") if p.part in added), *_named(found, "postings+")], _POSTING)
        postings = still.unionByName(_summed(moved, ["term", "chunk_id"], ["tf", "length"]).where("tf > 0"))
    terms = _rows(spark, [*_named(found, "terms"), *_named(found, "terms+")], "term string, df bigint")
    if _named(found, "terms+"):
        terms = _summed(terms, ["term"], ["df"]).where("df > 0")
    return Index(_newest(spark, found, "chunks"), postings, terms, _newest(spark, found, "vectors"), spark.read.parquet(_named(found, "stats")[0].path), number, _rows(spark, [*_named(found, "postings"), *_named(found, "postings+")], _POSTING))


def read(spark: SparkSession, path: str, version: int | None = None, check: bool = True) -> Index:
    """The index that was published last, or a version of it. Its stats must agree with its chunks, unless that isn't to be checked."""
    index = _open(spark, *versions.pieces(spark, path, version))
    if check:
        seen = index.chunks.agg(F.count(F.lit(1)).alias("rows"), F.sum("token_count").alias("tokens"))
        checks.assert_none(index.stats.join(F.broadcast(seen)).where("n <> rows or not (sum_token_count <=> coalesce(tokens, 0))"), "the index's statistics are not those of its chunks")
    return index


def changes(index: Index, chunks: DataFrame) -> DataFrame:
    """chunk_id and change for each chunk that differs between the index and the corpus as it is now."""
    rest = [c for c in CHUNK if c != "chunk_id"]
    digest = F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256)
    mark = lambda rows, side: rows.select("chunk_id", F.struct("sha256", "token_count", digest.alias("whole")).alias(side))
    both = mark(index.chunks, "a").join(mark(chunks, "b"), "chunk_id", "full_outer")
    same = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~same("sha256") | ~same("token_count"), "changed").when(~same("whole"), "moved")
    return both.select("chunk_id", change.alias("change")).where("change is not null")


def _parts_of(rows: DataFrame, lows: list[str]) -> DataFrame:
    """rows with the part whose range their (term, chunk_id) is in; lows are the parts' least keys, in order."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = np.array(lows, object)
        for batch in batches:
            keys = pc.binary_join_element_wise(batch.column("term"), batch.column("chunk_id"), "\0").to_numpy(zero_copy_only=False)
            part = np.maximum(np.searchsorted(ends, keys, "right") - 1, 0).astype(np.int32) if len(batch) else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], [*batch.schema.names, "part"])

    return rows.mapInArrow(place, f"{_POSTING}, part int")


def _with_sign(rows: DataFrame, sign: int) -> DataFrame:
    return rows.select("term", "chunk_id", (F.col("tf") * sign).alias("tf"), (F.col("length") * sign).alias("length"), F.lit(sign).alias("df"))


def upgrade(spark: SparkSession, path: str, chunks: DataFrame, encode: Callable[[DataFrame], DataFrame], model: str = "given", text: str = "content") -> int:
    """Bring the last version to the corpus as chunks has it now, and publish the result as a new version; gives its number, which is the old one's if nothing has changed.

    encode turns rows (chunk_id, text) into (chunk_id, embedding); it gets the chunks whose `text` has changed, by its digest, and all of them if the model is another. Old and new contents of changed chunks are tokenized, and
    nothing else; their postings and frequencies are added with a sign, to the ranges that they fall in.
    """
    number, found = versions.pieces(spark, path)
    now = _open(spark, number, found)
    chunks = chunks.select(*CHUNK, *({text} - set(CHUNK)))
    before = now.stats.first()  # one row
    other_model = before["model"] != model
    diff = stored(changes(now, chunks), "changes")
    if diff.isEmpty() and not other_model:
        return number
    number += 1
    place = versions.folder(path, number)
    fresh = stored(chunks.join(diff, "chunk_id"), "changed-chunks")  # added, changed, moved
    gone = diff.where("change = 'removed'").select("chunk_id")
    pieces = [p for p in found if p.name != "stats"]

    null = lambda c: F.lit(None).cast(now.chunks.schema[c].dataType).alias(c)
    rows = fresh.select(*CHUNK, F.lit(False).alias("gone")).unionByName(gone.select("chunk_id", *(null(c) for c in CHUNK if c != "chunk_id"), F.lit(True).alias("gone")))
    rows = _put(rows, spark, f"{place}/chunks+")
    pieces.append(Piece("chunks+", -1, number, rows.count(), None, f"{place}/chunks+"))

    old = stored(now.chunks.join(diff.where("change in ('changed', 'removed')"), "chunk_id", "left_semi"), "old-chunks")
    new = fresh.where("change in ('added', 'changed')")
    signed = stored(_with_sign(_postings(old), -1).unionByName(_with_sign(_postings(new), 1)), "signed-postings")
    each = _summed(signed, ["term", "chunk_id"], ["tf", "length"]).where("tf <> 0 or length <> 0")
    lows = {p.part: p.low for p in _named(found, "postings")}
    ends = [low for _, low in sorted(lows.items())]
    if sorted(lows) != list(range(len(lows))):  # ranges that were empty when they were made have no part
        each = _parts_of(each, ends).join(F.broadcast(spark.createDataFrame(list(enumerate(sorted(lows))), "part int, __part int")), "part").drop("part").withColumnRenamed("__part", "part")
    else:
        each = _parts_of(each, ends or [""])
    pieces += _put_parts(each.repartitionByRange("part", "term", "chunk_id"), spark, "postings+", number, f"{place}/postings+", {})
    terms = _put(_summed(signed, ["term"], ["df"]).where("df <> 0"), spark, f"{place}/terms+")
    pieces.append(Piece("terms+", -1, number, terms.count(), None, f"{place}/terms+"))

    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    asked = (chunks if other_model else fresh).select("chunk_id", F.col(text).alias("text"), digest.alias("embedding_sha256"))
    if not other_model:
        asked = asked.join(now.vectors.select("chunk_id", "embedding_sha256"), ["chunk_id", "embedding_sha256"], "left_anti")
    asked = stored(asked, "to-encode")
    kinds = {f.name: f.dataType for f in now.vectors.schema}
    made = encode(asked.select("chunk_id", "text")).join(asked.select("chunk_id", "embedding_sha256"), "chunk_id", "right").select(*(F.col(c).cast(kinds[c]) for c in ("chunk_id", "embedding", "embedding_sha256")))
    if other_model:
        made = _put(made, spark, f"{place}/vectors")
        pieces = [p for p in pieces if not p.name.startswith("vectors")] + [Piece("vectors", -1, number, made.count(), None, f"{place}/vectors")]
    else:
        lost = gone.select("chunk_id", F.lit(None).cast(kinds["embedding"]).alias("embedding"), F.lit(None).cast("string").alias("embedding_sha256"), F.lit(True).alias("gone"))
        both = _put(made.withColumn("gone", F.lit(False)).unionByName(lost), spark, f"{place}/vectors+")
        made = both.where("not gone").drop("gone")
        pieces.append(Piece("vectors+", -1, number, both.count(), None, f"{place}/vectors+"))

    moved = lambda rows: rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("t")).first()
    less, more = moved(old), moved(new)
    n, tokens = before["n"] + more["n"] - less["n"], before["sum_token_count"] + more["t"] - less["t"]
    size = made.agg(F.max(F.size("embedding"))).first()[0]
    dimensions = (size or 0) if other_model or not before["n"] else before["dimensions"]
    _put(spark.createDataFrame([(n, tokens, tokens / n if n else None, dimensions, model)], now.stats.schema), spark, f"{place}/stats")
    pieces.append(Piece("stats", -1, number, 1, None, f"{place}/stats"))

    after = _open(spark, number, pieces)
    beside = F.explode(F.array("chunk_id", "previous_id", "next_id")).alias("chunk_id")
    near = fresh.select(beside).unionByName(now.chunks.join(diff, "chunk_id", "left_semi").select(beside)).where("chunk_id is not null").distinct()
    _assert_sound({
        "a chunk is wrong": chunk_errors(after.chunks.join(near, "chunk_id", "left_semi"), after.chunks).unionByName(fresh.groupBy("chunk_id").count().where("count > 1").select("chunk_id", F.lit("repeated").alias("error"))),
        "a vector isn't finite, or has another length": _vector_errors(made, dimensions),
        "a vector is there more than once": made.groupBy("chunk_id").count().where("count > 1"),
        "a chunk has no vector": fresh.select("chunk_id").join(after.vectors, "chunk_id", "left_anti"),
    })
    versions.publish(spark, path, number, pieces)
    return number


def compact(spark: SparkSession, path: str, share: float = 0.25) -> int:
    """Rewrite the ranges of postings, and the tables, whose additions have at least this share of their base's rows, and publish the result; gives the version, the old one if there is nothing to do."""
    number, found = versions.pieces(spark, path)
    now, number = _open(spark, number, found), number + 1
    place = versions.folder(path, number)
    grown = lambda name: {p: sum(x.rows for x in _named(found, f"{name}+") if x.part == p) for p in {x.part for x in _named(found, f"{name}+")}}
    base = {(p.name, p.part): p for p in found if not p.name.endswith("+")}
    pieces = list(found)
    for name, table in (("chunks", now.chunks), ("vectors", now.vectors), ("terms", now.terms)):
        if any(n >= share * base[name, -1].rows for n in grown(name).values()):
            rows = _put(table if name != "terms" else table.repartitionByRange("term").sortWithinPartitions("term"), spark, f"{place}/{name}")
            pieces = [p for p in pieces if p.name not in (name, f"{name}+")] + [Piece(name, -1, number, rows.count(), None, f"{place}/{name}")]
    due = {part for part, n in grown("postings").items() if ("postings", part) not in base or n >= share * base["postings", part].rows}
    if due:
        rows = None
        for p in found:
            if p.name.startswith("postings") and p.part in due:
                more = spark.read.schema(_POSTING).parquet(p.path).withColumn("part", F.lit(p.part))
                rows = more if rows is None else rows.unionByName(more)
        merged = _summed(rows, ["part", "term", "chunk_id"], ["tf", "length"]).where("tf > 0").repartitionByRange("part", "term", "chunk_id")
        lows = {part: base["postings", part].low if ("postings", part) in base else "" for part in due}
        made = _put_parts(merged, spark, "postings", number, f"{place}/postings", lows)
        empty = [replace(base["postings", part], rows=0, level=number) for part in due - {p.part for p in made} if ("postings", part) in base]
        if empty:  # all postings of these are gone: the range stays, as a folder without rows
            nothing = _put(spark.createDataFrame([], _POSTING), spark, f"{place}/nothing")
            made += [replace(p, path=f"{place}/nothing") for p in empty if nothing.isEmpty()]
        pieces = [p for p in pieces if not (p.name.startswith("postings") and p.part in due)] + made
    if pieces == found:
        return number - 1
    versions.publish(spark, path, number, pieces)
    return number


def row_numbers(chunks: DataFrame) -> DataFrame:
    """chunk_id and vector_row, from 0 in the order of ids."""
    return numbered(chunks.select("chunk_id"), [F.col("chunk_id")], "n").select("chunk_id", (F.col("n") - 1).alias("vector_row"))
