"""Benchmark decontamination.

A hash set of the benchmark's normalised word n-grams is broadcast; each task scans the word windows of its documents with numpy,
verifies every hit on the words themselves, and gives the hit word spans and the items they come from. Whole documents or only the
hit spans can then be removed.

A benchmark of more than `broadcast_bytes` of text is cut into parts of at most that size (by a hash of its rows); the documents are scanned once
for each part and the spans are merged by document row, so that the broadcast stays bounded whatever the benchmark's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm._shared import lean, row_at, written
from skein.llm._words import ALNUM, signed, words_of

WINDOW = 13
BROADCAST_BYTES = 16 << 20
_SPANS = "n_words bigint, spans array<struct<first:int,last:int>>, items array<{}>"


class _NGrams:
    """The windows of a part of the benchmark, by length and hash, with their words and items. Small: broadcast."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        self.by_length: dict[int, dict[int, list[tuple[bytes, list[int]]]]] = {}
        for item_id, text in items:
            for w in words_of(pa.array([text], pa.string()), ALNUM):
                k = min(window, len(w))
                if not k:
                    continue
                hashes = signed(w.window_hashes(w.hashes(), k))
                known = self.by_length.setdefault(k, {})
                for i in range(len(w) - k + 1):
                    words, entries = w.joined(i, i + k), known.setdefault(int(hashes[i]), [])
                    entry = next((e for e in entries if e[0] == words), None)
                    if entry is None:
                        entries.append(entry := (words, []))
                    if item_id not in entry[1]:
                        entry[1].append(item_id)
        self.lookup = {}
        for k, known in self.by_length.items():
            hashes = np.sort(np.array(list(known), np.int64))
            seen = np.zeros(1 << 20, bool)  # most windows end at this test
            seen[hashes & ((1 << 20) - 1)] = True
            self.lookup[k] = seen, hashes


def _scan(ngrams, column: str, others: list[str], ids_are_text: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = ngrams.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column))
            counts, spans, items = [], [], []
            for w in words_of(texts, ALNUM):
                h, doc = w.hashes(), w.doc_of_word()
                found: dict[int, tuple[list, set]] = {}
                for k, known in grams.by_length.items():
                    seen, hashes = grams.lookup[k]
                    at = signed(w.window_hashes(h, k))
                    maybe = np.flatnonzero(seen[at & ((1 << 20) - 1)] & w.inside(k))
                    maybe = maybe[np.isin(at[maybe], hashes)]
                    for i in maybe.tolist():
                        words = w.joined(i, i + k)
                        for text, ids in known[int(at[i])]:
                            if text == words:
                                mine = found.setdefault(int(doc[i]), ([], set()))
                                mine[0].append((i, i + k))
                                mine[1].update(ids)
                counts.append(w.counts)
                for d in range(w.hi - w.lo):
                    if d not in found:
                        spans.append([])
                        items.append([])
                        continue
                    merged: list[list[int]] = []
                    for a, b in sorted(found[d][0]):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(b, merged[-1][1])
                        else:
                            merged.append([a, b])
                    zero = int(w.bounds[d])
                    spans.append([{"first": a - zero, "last": b - zero} for a, b in merged])
                    items.append(sorted(found[d][1]))
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in others]
            arrays += [pa.array(np.concatenate(counts) if counts else np.empty(0, np.int64), pa.int64())]
            arrays += [pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), pa.array(items, pa.list_(pa.string() if ids_are_text else pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*others, "n_words", "spans", "items"])

    return scan


def _merged_spans(spans):
    """Overlapping or touching [first, last) spans of an array as one."""
    empty = F.array().cast("array<struct<first:int,last:int>>")
    return F.aggregate(
        F.array_sort(spans),
        empty,
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["last"] >= x["first"]),
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(F.struct(F.try_element_at(done, F.lit(-1))["first"].alias("first"), F.greatest(F.try_element_at(done, F.lit(-1))["last"], x["last"]).alias("last"))),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES, text: str = "text") -> DataFrame:
    """All columns of docs, with n_words, spans (hit words as [first, last) from word 0) and items (sorted ids of items with a window in the text).

    benchmark has item_id, a number or a string, and text. A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window.
    Null texts have no words, rows of the benchmark without an id or text are left out, and an item that is repeated counts once. A row of docs gives one row, also when
    rows are repeated. Columns of docs named n_words, spans or items are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "spans", "items")
    kind = "string" if dict(benchmark.dtypes)["item_id"] == "string" else "bigint"
    tests = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast(kind).alias("item_id"), "text").distinct()
    total = tests.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = max(1, -(-total // (broadcast_bytes // 2)))
    out = T._parse_datatype_string(_SPANS.format(kind))
    if parts == 1:
        grams = spark.sparkContext.broadcast(_NGrams([tuple(r) for r in tests.collect()], window))
        return docs.mapInArrow(lean(_scan(grams, text, docs.columns, kind == "string")), T.StructType([*docs.schema.fields, *out.fields]))
    rows, found = written(row_at(docs, "__row"), "rows"), None
    texts = rows.select("__row", text)
    for part in range(parts):
        some = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        grams = spark.sparkContext.broadcast(_NGrams([tuple(r) for r in some.collect()], window))
        hits = texts.mapInArrow(lean(_scan(grams, text, ["__row"], kind == "string")), T.StructType([texts.schema["__row"], *out.fields]))
        hits = hits.where(F.size("spans") > 0) if part else hits
        found = hits if found is None else found.unionByName(hits)
    found = found.groupBy("__row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return rows.join(found.withColumn("spans", _merged_spans(F.col("spans"))), "__row").drop("__row")


def _cut(column: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            texts, spans = batch.column(at), batch.column(batch.schema.get_field_index("spans")).to_pylist()
            kept = texts.to_pylist()
            for w in words_of(texts, ALNUM):
                for d in range(w.lo, w.hi):
                    if spans[d]:
                        left, pieces = int(w.offsets[d - w.lo]), []
                        for s in spans[d]:
                            i = int(w.bounds[d - w.lo])
                            pieces.append(w.data[left : w.starts[i + s["first"]]].tobytes())
                            left = int(w.ends[i + s["last"] - 1])
                        pieces.append(w.data[left : int(w.offsets[d - w.lo + 1])].tobytes())
                        kept[d] = b"".join(pieces).decode()
            yield pa.RecordBatch.from_arrays([pa.array(kept, texts.type) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return cut


def remove_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """Rows of contamination() with the hit words cut from their texts; what stood between words stays."""
    return found.mapInArrow(lean(_cut(text)), found.schema)


def contaminated(share: int = 20):
    """The contract's rule over rows of contamination(): at least one word in `share` is hit."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + (s["last"] - s["first"]).cast("bigint"))
    return (hit > 0) & (F.lit(share) * hit >= F.col("n_words"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that are not contaminated, with the columns of docs, whatever their names."""
    names = {c: f"__own_{c}" if c in ("n_words", "spans", "items") else c for c in docs.columns}
    kept = contamination(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), benchmark, **options).where(~contaminated())
    return kept.select(*(F.col(f"`{n}`").alias(c) for c, n in names.items()))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(docs.select("doc_id", "text"), benchmark)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + (s["last"] - s["first"]).cast("bigint"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), items AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), grams AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS k, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS gram
  FROM items, unnest(range(1, greatest(2, len(ws) - 11))) AS u(i) WHERE len(ws) > 0
), sizes AS (SELECT DISTINCT k FROM grams), places AS (
  SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS gram FROM words, sizes, unnest(range(1, len(ws) - k + 2)) AS u(i)
), hits AS (SELECT DISTINCT doc_id, i, p.k, item_id FROM places p JOIN grams g ON p.gram = g.gram AND p.k = g.k),
hit_words AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hits, unnest(range(0, k)) AS u(j) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM words w LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
