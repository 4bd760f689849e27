"""Quality classifier: a small convolutional network over bytes, in numpy.

A text's UTF-8 bytes are embedded in DIMS numbers each. FILTERS learned filters of KERNEL bytes move over them in steps of STEP bytes. Chunks of CHUNK bytes (each reaches KERNEL - STEP bytes into the
next one, so that they overlap and cover the whole text) are max-pooled; the largest and the mean value of each filter over the chunks go into one logistic unit.

Training runs on the driver, on a bounded sample: of the labelled documents that are there, at most `per_class` texts of each label, those with the smallest hash of their id, and of these, in that order, all that
fit half of `sample_bytes` for their label; what doesn't fit is passed over. A text of more than LONGEST bytes is trained on with SPANS spans at even distances over the whole of it, LONGEST / 4 characters together, so that each label that occurs is in the sample. Scoring runs in Spark's tasks with
the weights (about 16 KB) in the closure and reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm._shared import lean, row_at, written
from skein.llm._words import CHUNK_BYTES, texts_as_bytes

DIMS, FILTERS, KERNEL, STEP, CHUNK = 4, 24, 8, 4, 256
PER_CLASS, SAMPLE_BYTES, EPOCHS, SEED = 1200, 24 << 20, 12, 7
#: Steps of training at least; few texts are gone over more often.
STEPS = 600
#: Bytes of the longest text that is trained on whole.
LONGEST = 1 << 18
#: Spans of a longer one.
SPANS = 64
THRESHOLD = 0.7
_BLOCKS = CHUNK // STEP


@dataclass
class Weights:
    embed: np.ndarray  # 256 x DIMS; byte 0 is padding
    filters: np.ndarray  # KERNEL * DIMS x FILTERS
    shift: np.ndarray  # FILTERS
    out: np.ndarray  # 2 * FILTERS
    bias: np.ndarray  # 1

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.shift, self.out, self.bias]


@dataclass
class _Laid:
    """Texts as rows of STEP bytes, each with KERNEL // STEP - 1 rows of padding behind it; where chunks and texts begin."""

    rows: np.ndarray
    chunk_at: np.ndarray
    chunks: np.ndarray  # by text
    padding: np.ndarray  # the rows of padding


def _laid(data: np.ndarray, at: np.ndarray) -> _Laid:
    sizes = np.diff(at)
    blocks = np.maximum(-(-sizes // STEP), 1)
    room = blocks + KERNEL // STEP - 1
    first = np.concatenate(([0], np.cumsum(room)))
    padded = np.zeros(int(first[-1]) * STEP, np.uint8)
    for i, (a, n) in enumerate(zip(at[:-1].tolist(), sizes.tolist(), strict=True)):
        p = int(first[i]) * STEP
        padded[p : p + n] = data[a : a + n]
    chunks = -(-blocks // _BLOCKS)
    within = np.arange(int(chunks.sum())) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    padding = (first[1:, None] - np.arange(1, KERNEL // STEP)).ravel()
    return _Laid(padded.reshape(-1, STEP), np.repeat(first[:-1], chunks) + within * _BLOCKS, chunks, padding)


def _pooled(w: Weights, laid: _Laid) -> tuple[np.ndarray, np.ndarray]:
    """The filters' values at each row, and their largest over each chunk. What starts in padding, and may reach into the next text, counts as 0, the least value."""
    x = w.embed[laid.rows].reshape(len(laid.rows), STEP * DIMS)
    y = x @ w.filters[: STEP * DIMS]
    for k in range(1, KERNEL // STEP):
        y[:-k] += x[k:] @ w.filters[k * STEP * DIMS : (k + 1) * STEP * DIMS]
    y += w.shift
    np.maximum(y, 0, out=y)
    y[laid.padding] = 0
    return y, np.maximum.reduceat(y, laid.chunk_at, axis=0)


def _features(pooled: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    at = np.cumsum(chunks) - chunks
    return np.hstack([np.maximum.reduceat(pooled, at, axis=0), np.add.reduceat(pooled, at, axis=0) / chunks[:, None]])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scores(w: Weights, texts: pa.Array) -> np.ndarray:
    """The probability of label 1 for each text of a column, about CHUNK_BYTES at a time."""
    data, at = texts_as_bytes(texts)
    out, lo, n = [], 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK_BYTES, "right")) - 1)
        laid = _laid(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        out.append(_sigmoid(_features(_pooled(w, laid)[1], laid.chunks) @ w.out + w.bias))
        lo = hi
    return np.concatenate(out).astype(np.float64) if out else np.empty(0)


def _start(seed: int) -> Weights:
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.5, (256, DIMS)).astype(np.float32)
    embed[0] = 0
    return Weights(embed, rng.normal(0, 0.35, (KERNEL * DIMS, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), np.zeros(1, np.float32))


def _gradients(w: Weights, laid: _Laid, label: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    y, pooled = _pooled(w, laid)
    feats = _features(pooled, laid.chunks)
    off = ((_sigmoid(feats @ w.out + w.bias) - label) * weight).astype(np.float32)
    at = np.cumsum(laid.chunks) - laid.chunks
    text = np.repeat(np.arange(len(laid.chunks)), laid.chunks)
    best = feats[:, :FILTERS]
    is_best = (pooled == best[text]) & (pooled > 0)
    share = is_best / np.maximum(np.add.reduceat(is_best, at, axis=0), 1)[text]
    g = off[text, None] * (share * w.out[:FILTERS] + w.out[FILTERS:] / laid.chunks[text, None])
    g *= pooled > 0
    # back to the row of each chunk that gave the largest value
    ends = np.append(laid.chunk_at[1:], len(y))
    where = np.empty(pooled.shape, np.int64)
    for c, (a, b) in enumerate(zip(laid.chunk_at.tolist(), ends.tolist(), strict=True)):
        where[c] = a + y[a:b].argmax(axis=0)
    d_filters, d_embed = np.zeros_like(w.filters), np.zeros_like(w.embed)
    for k in range(KERNEL // STEP):
        rows = np.minimum(where + k, len(laid.rows) - 1)
        taken = laid.rows[rows]  # chunk x filter x STEP
        x = w.embed[taken].reshape(*rows.shape, STEP * DIMS)
        part = slice(k * STEP * DIMS, (k + 1) * STEP * DIMS)
        d_filters[part] = np.einsum("cf,cfx->xf", g, x)
        back = (g[:, :, None] * w.filters[part].T[None]).reshape(-1, DIMS)
        flat = taken.reshape(-1)
        for d in range(DIMS):
            d_embed[:, d] += np.bincount(flat, back[:, d], 256).astype(np.float32)
    d_embed[0] = 0
    return [d_embed, d_filters, g.sum(axis=0), feats.T @ off, off.sum(keepdims=True)]


def _clip(text: str, rng: np.random.Generator) -> str:
    words = text.split(" ")
    n = int(rng.integers(1, 13))
    at = int(rng.integers(0, max(1, len(words) - n)))
    return " ".join(words[at : at + n])


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Weights:
    """Adam on the cross-entropy, both labels with equal weight. Each text of label 1 gives a second one, up to 12 of its words in a row, so that few bytes alone don't count as bad. With one label only, or none, all texts get one score: (ones + 1) / (rows + 2)."""
    w, rng = _start(seed), np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        w.out[:] = 0
        p = (y.sum() + 1) / (len(y) + 2)
        w.bias[0] = np.log(p / (1 - p))
        return w
    clips = [_clip(t, rng) for t, label in zip(texts, labels, strict=True) if label == 1]
    texts, y = [*texts, *clips], np.append(y, np.ones(len(clips), np.float32))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    raw = [t.encode() for t in texts]
    means, squares, step = [np.zeros_like(a) for a in w.arrays()], [np.zeros_like(a) for a in w.arrays()], 0
    epochs = max(epochs, -(-STEPS // -(-len(raw) // 48)))
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        order = rng.permutation(len(raw))
        for k in range(0, len(order), 48):
            some = order[k : k + 48]
            at = np.concatenate(([0], np.cumsum([len(raw[i]) for i in some])))
            laid = _laid(np.frombuffer(b"".join(raw[i] for i in some), np.uint8), at)
            grads = _gradients(w, laid, y[some], weight[some] / len(some))
            step += 1
            for a, g, m, v in zip(w.arrays(), grads, means, squares, strict=True):
                g = g + (1e-4 * a if a.ndim == 1 else 0)
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                a -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds. A null id counts as the text null."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % folds


def _spans(text: Column, characters: int) -> Column:
    """At most so many characters, of which the text has as many, in SPANS spans that begin at even distances from its start on."""
    each = max(1, characters // SPANS)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(min(SPANS, characters) - 1)), lambda i: F.substring(text, F.floor(i * F.length(text) / min(SPANS, characters)).cast("int") + 1, F.lit(each))), "")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES, **options) -> Weights:
    """Train on labelled rows whose fold (of 4) isn't 2. labels has doc_id and quality; labels other than 0 and 1, and ids with both, are left out, as are those of documents that docs lacks. Ids may be of any type that compares with docs'."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    known = known.where(F.col("quality") == F.col("other")).where(fold(F.col("doc_id"), 4) != 2).select("doc_id", F.col("quality").cast("int").alias("quality"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    picked = None
    for label in (0, 1):
        part = known.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    some = F.broadcast(picked.select(F.col("doc_id").alias("__id"), "quality"))  # at most 2 * per_class
    longest = min(LONGEST, sample_bytes // 2)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").alias("__id"), F.when(F.octet_length(text) > longest, _spans(text, longest // 4)).otherwise(text).alias("text")).join(some, "__id")
    rows = written(row_at(rows.select("quality", "text", F.xxhash64("__id").alias("h"), F.xxhash64("text").alias("t"), F.octet_length("text").alias("size")), "row"), "sample")
    picks = []
    for label in (0, 1):
        left = sample_bytes // 2
        for r in rows.where(F.col("quality") == label).select("h", "t", "size", "row").orderBy("h", "t").limit(per_class).collect():
            if r["size"] <= left:
                left -= r["size"]
                picks.append(r["row"])
    sample = sorted(rows.where(F.col("row").isin(picks)).select("h", "t", "text", "quality").collect())  # at most sample_bytes of text
    texts, quality = [r["text"] for r in sample], [r["quality"] for r in sample]
    return train(texts, quality, **options)


def score(docs: DataFrame, weights: Weights, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability of good quality. Null texts are empty; empty texts get a score too. A column of docs with the name `out` is replaced."""
    docs = docs.drop(out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(weights, batch.column(batch.schema.get_field_index(text))))], names=[*batch.schema.names, out])

    return docs.mapInArrow(lean(work), T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= 0.7)."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier doesn't reject."""
    return score(docs, fit(docs, labels), out="__score").where(F.col("__score") >= THRESHOLD).select(*docs.columns)
