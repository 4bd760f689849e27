"""How filters of a corpus interact: what each removes in every order, alone, and in vain.

Tasks scan the bytes of Arrow text buffers: byte classes and their prefix sums give words, capitals, code points and symbols of each text, and sorted hashes of a document's words its distinct ones; words of equal hashes are
compared byte by byte, and a document where they differ is counted by its words. Texts are identical if their SHA-256 is. Conditions are bits of a mask; documents are reduced to counts by part and mask, at most 32 for each part, before any
order is looked at: all orders are one product of these counts with a fixed 0/1 matrix.

Defined cases: a null text is empty; a null part is the empty string. Null ids count as larger than all others, and are not smaller than one another. Rows of one id and text are not smaller than each other. Labels of null ids match nothing; of several
labels of an id, one is enough. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm._shared import hot_join, lean, written
from skein.llm._words import CHUNK_BYTES, SPACED, Words, mix, words_of

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 200, 50, 2, "#$%&*|"
MEASURES = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")
#: Counts of a row of the audit, besides part, filter_order and step.
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_POINT = np.ones(256, bool)
_POINT[0x80:0xC0] = False  # bytes that continue a code point


def _word_hashes(w: Words) -> np.ndarray:
    """Hashes of all words, a stretch of about CHUNK_BYTES after the other."""
    out, i = np.empty(len(w), np.uint64), 0
    while i < len(w):
        j = max(i + 1, int(np.searchsorted(w.ends, w.starts[i] + CHUNK_BYTES, "right")))
        at = w.starts[i]
        out[i:j] = replace(w, data=w.data[at : w.ends[j - 1]], starts=w.starts[i:j] - at, ends=w.ends[i:j] - at).hashes()
        i = j
    return out


def _equal(w: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a[i] and b[i] have the same bytes."""
    lengths = w.ends[a] - w.starts[a]
    same, i = lengths == w.ends[b] - w.starts[b], 0
    ends = np.cumsum(lengths)
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CHUNK_BYTES, "right")))
        some = np.arange(i, j)[same[i:j]]
        n = lengths[some]
        first = np.cumsum(n) - n
        within = np.arange(int(n.sum())) - np.repeat(first, n)
        left, right = w.data[np.repeat(w.starts[a[some]], n) + within], w.data[np.repeat(w.starts[b[some]], n) + within]
        if len(some):
            same[some] = np.logical_and.reduceat(left == right, first)
        i = j
    return same


def _distinct(w: Words, hashes: np.ndarray | None = None) -> np.ndarray:
    """Distinct words of each text, exact whatever the hashes."""
    h = _word_hashes(w) if hashes is None else hashes
    doc = w.doc_of_word()
    keys = h ^ mix(doc.astype(np.uint64) + np.uint64(1))  # so that one sort brings together a text's equal words
    order = np.argsort(keys)
    again = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    a, b = order[again], order[again + 1]
    true = (doc[a] == doc[b]) & _equal(w, a, b)
    out = w.counts - np.bincount(doc[a[true]], minlength=w.hi - w.lo)
    for d in np.unique(np.concatenate([doc[a[~true]], doc[b[~true]]])):  # other words with an equal hash
        out[d] = len({w.data[w.starts[i] : w.ends[i]].tobytes() for i in range(w.bounds[d], w.bounds[d + 1])})
    return out


def _counted(keep: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes of a class in each text, from the class's prefix sums."""
    sums = np.zeros(len(keep) + 1, np.int32 if len(keep) < 2**31 else np.int64)
    np.cumsum(keep, out=sums[1:])
    return np.diff(sums[offsets]).astype(np.int64)


def _scan(symbols: str):
    marked = np.zeros(256, bool)
    marked[list(symbols.encode())] = True

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(len(batch), np.int64) for _ in MEASURES]
            for w in words_of(batch.column("__text"), SPACED):
                measured = w.counts, _distinct(w), _counted(_CAPITAL[w.data], w.offsets), _counted(_POINT[w.data], w.offsets), _counted(marked[w.data], w.offsets)
                for out, values in zip(found, measured, strict=True):
                    out[w.lo : w.hi] = values
            rest = batch.drop_columns(["__text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, *(pa.array(x) for x in found)], [*rest.schema.names, *MEASURES])

    return scan


def measure(docs: DataFrame, text: str = "text", symbols: str = SYMBOLS) -> DataFrame:
    """docs without the text, with n_words, n_distinct (words), n_capitals (A-Z), n_points (code points) and n_symbols, all of the whole text. symbols are ASCII. Columns with these names are replaced."""
    if not symbols.isascii():
        raise ValueError("symbols must be ASCII")
    rest = [c for c in docs.columns if c not in (text, *MEASURES)]
    schema = T.StructType([*(docs.schema[c] for c in rest), *(T.StructField(m, T.LongType()) for m in MEASURES)])
    return docs.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(lean(_scan(symbols)), schema)


def failures(docs: DataFrame, part: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, part and fails, a mask: bit i is set if the document fails the i-th of FILTERS.

    A: under 200 words; B: fewer than half of the words are distinct; C: more than 2% of the code points are capitals; D: holds a symbol; E: a smaller id has the same text.
    """
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)).alias("key"), F.col(f"`{text}`").alias("text")
    )
    own = [
        F.col("n_words") < MIN_WORDS,
        100 * F.col("n_distinct") < DISTINCT_PERCENT * F.col("n_words"),
        100 * F.col("n_capitals") > CAPITAL_PERCENT * F.col("n_points"),
        F.col("n_symbols") > 0,
    ]
    mask = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(own)), F.lit(0))
    rows = written(measure(rows).select("doc_id", "part", "key", mask.alias("fails")), "audit-rows")
    total = rows.count()
    first = written(rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "audit-copies")
    copied = (F.col("doc_id") > F.col("first")) | (F.col("doc_id").isNull() & F.col("first").isNotNull())
    return hot_join(rows, first, ["key"], total, "left").select("doc_id", "part", F.when(copied, F.col("fails") + (1 << len(own))).otherwise(F.col("fails")).alias("fails"))


def _orders() -> tuple[list[str], np.ndarray]:
    """All orders, and for each of COUNTS which masks count, by order and step: the third axis is order * 5 + step."""
    orders = ["".join(p) for p in itertools.permutations(FILTERS)]
    masks = np.arange(1 << len(FILTERS))
    ones = np.array([m.bit_count() for m in masks])
    out = np.zeros((len(COUNTS), len(masks), len(orders) * len(FILTERS)), np.int64)
    for o, order in enumerate(orders):
        before = 0
        for s, f in enumerate(order):
            bit = 1 << FILTERS.index(f)
            fails, past = masks & bit > 0, masks & before > 0
            here = fails & ~past
            each = np.where(fails, len(orders) // np.maximum(ones, 1), 0)  # orders in which the filter comes first of those that the mask fails
            out[:, :, o * len(FILTERS) + s] = masks & (before | bit) == 0, here, fails & past, masks == bit, here, here, each
            before |= bit
    return orders, out


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    orders, chosen = _orders()
    steps = len(FILTERS)
    names, nth = np.repeat(np.array(orders), steps), np.tile(np.arange(1, steps + 1, dtype=np.int32), len(orders))
    for batch in batches:
        for at in range(0, len(batch), 64):
            some = batch.slice(at, 64)
            held = np.zeros((3, len(some), 1 << steps), np.int64)
            masks = some.column("masks")
            row = np.repeat(np.arange(len(some)), masks.value_lengths().to_numpy())
            fields = dict(zip(("fails", "n", "good", "toxic"), masks.flatten().flatten(), strict=True))
            for k, c in enumerate(("n", "good", "toxic")):
                np.add.at(held[k], (row, fields["fails"].to_numpy()), fields[c].to_numpy())
            source = [0, 0, 0, 0, 1, 2, 0]  # of each of COUNTS
            counts = [(held[k] @ chosen[i]).ravel() for i, k in enumerate(source)]
            parts = some.column("part").take(pa.array(np.repeat(np.arange(len(some)), len(names))))
            yield pa.RecordBatch.from_arrays([parts, pa.array(np.tile(names, len(some))), pa.array(np.tile(nth, len(some))), *(pa.array(c) for c in counts)], ["part", "filter_order", "step", *COUNTS])


def interactions(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from rows of failures() and labels (doc_id, quality, toxic)."""
    by_id = failed.groupBy("doc_id", "part", "fails").agg(F.count(F.lit(1)).alias("n"))  # so that an id that is repeated, or null, meets its label a few times only
    known = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    n = lambda flag: F.sum(F.when(F.col(flag) == 1, F.col("n")).otherwise(F.lit(0).cast("bigint"))).alias(flag)
    masks = by_id.join(known, "doc_id", "left").groupBy("part", "fails").agg(F.sum("n").alias("n"), n("good"), n("toxic"))
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("masks"))  # at most 32
    return parts.mapInArrow(_reduce, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every part with all 120 orders and 5 steps."""
    return interactions(failures(docs), labels)


ORACLE_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), firsts AS (SELECT text, min(doc_id) AS first FROM texts GROUP BY text), known AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN texts.doc_id > first OR (texts.doc_id IS NULL AND first IS NOT NULL) THEN 'E' ELSE '' END AS fails
  FROM texts JOIN firsts USING (text) LEFT JOIN known USING (doc_id)
), sets AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, CAST(i AS INTEGER) AS step, filter_order[i] AS f, '[' || filter_order[1:i - 1] || '0]' AS earlier FROM orders, unnest(range(1, 6)) AS u(i)
), marked AS (
  SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS here, regexp_matches(fails, earlier) AS gone, fails = f AS alone FROM sets, steps
), rows AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT here AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (here AND gone), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
    coalesce(sum(good) FILTER (here AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (here AND NOT gone), 0) AS toxic_lost
  FROM marked GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM rows
"""
