"""Embedding of texts by an injected model: loaded once in each Python worker, fed batches of a bounded size, its results checked; what fails is a row with an error, not a lost job."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Models that this worker process has loaded, by the encoder's identity.
_LOADED: dict[str, Callable[[list[str]], np.ndarray]] = {}


@dataclass(frozen=True)
class Encoder:
    """load gives the model, a function from texts to a matrix with a row for each. The names say what vectors depend on. A batch has at most batch_rows texts and, unless one text alone is longer, batch_bytes of UTF-8."""

    load: Callable[[], Callable[[list[str]], np.ndarray]]
    dimensions: int
    model: str
    revision: str = ""
    tokenizer: str = ""
    backend: str = ""
    precision: str = ""
    batch_rows: int = 16
    batch_bytes: int = 1 << 16

    def __post_init__(self) -> None:
        if self.dimensions < 1 or self.batch_rows < 1 or self.batch_bytes < 1 or not self.model:
            raise ValueError("an encoder has a name, dimensions, and batches of at least one text")

    @property
    def identity(self) -> str:
        """A digest of all that vectors depend on; a vector of another identity isn't reused."""
        parts = [str(getattr(self, f.name)) for f in fields(self) if f.name not in ("load", "batch_rows", "batch_bytes")]
        return hashlib.sha256("\0".join(parts).encode()).hexdigest()


def batches(sizes: list[int], most_rows: int, most_bytes: int) -> Iterator[tuple[int, int]]:
    """(first, end) of batches of texts of these sizes, in their order."""
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if i > first and (i - first >= most_rows or held + size > most_bytes):
            yield first, i
            first, held = i, 0
        held += size
    if sizes:
        yield first, len(sizes)


def _encoded(model, texts: list[str], dimensions: int) -> tuple[np.ndarray, list[str | None]]:
    """Unit vectors and errors of texts, one of them for each. A batch that fails as a whole is tried again text by text, so that one bad text doesn't take others with it."""
    try:
        made = np.asarray(model(texts), np.float64)
        wrong = None if made.shape == (len(texts), dimensions) else "shape"
    except Exception as why:  # whatever the model raises is a row's error
        made, wrong = None, f"failed: {type(why).__name__}"
    if wrong:
        if len(texts) == 1:
            return np.zeros((1, dimensions)), [wrong]
        each = [_encoded(model, [t], dimensions) for t in texts]
        return np.vstack([v for v, _ in each]), [e for _, es in each for e in es]
    finite = np.isfinite(made).all(axis=1)
    largest = np.abs(np.where(finite[:, None], made, 0.0)).max(axis=1)
    unit = np.where(finite[:, None], made, 0.0) / np.where(largest > 0, largest, 1.0)[:, None]  # so that squares neither vanish nor overflow
    unit = unit / np.where(largest > 0, np.linalg.norm(unit, axis=1), 1.0)[:, None]
    return unit, [None if ok and big > 0 else "zero" if ok else "not_finite" for ok, big in zip(finite, largest, strict=True)]


def encode(rows: DataFrame, encoder: Encoder, text: str = "text") -> DataFrame:
    """rows without the text, with embedding (unit length, null with an error) and error: empty, failed: (the exception's name), shape, not_finite or zero.

    Texts of an Arrow batch are fed in the order of their sizes, so that texts of a batch are about equally long.
    """
    rest = [c for c in rows.columns if c not in (text, "embedding", "error")]
    identity = encoder.identity

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if identity not in _LOADED:
            _LOADED.clear()  # one model at a time
            _LOADED[identity] = encoder.load()
        for batch in arrow:
            texts = batch.column("__text").to_pylist()
            sizes = [len(t.encode()) if t else 0 for t in texts]
            order = sorted((i for i, size in enumerate(sizes) if size), key=sizes.__getitem__)
            vectors, errors = np.zeros((len(texts), encoder.dimensions)), ["empty"] * len(texts)
            for first, end in batches([sizes[i] for i in order], encoder.batch_rows, encoder.batch_bytes):
                some = order[first:end]
                vectors[some], found = _encoded(_LOADED[identity], [texts[i] for i in some], encoder.dimensions)
                for i, error in zip(some, found, strict=True):
                    errors[i] = error
            offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * encoder.dimensions)
            lists = pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()), mask=pa.array([e is not None for e in errors]))
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["__text"]).columns, lists, pa.array(errors, pa.string())], [*rest, "embedding", "error"])

    from pyspark.sql import types as T

    schema = T.StructType([*(rows.schema[c] for c in rest), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())])
    return rows.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, schema)


def strict(encoder: Encoder) -> Callable[[DataFrame], DataFrame]:
    """For index.upgrade(): (chunk_id, text) to (chunk_id, embedding); a text with an error has no vector, which the index's checks refuse."""
    return lambda rows: encode(rows, encoder).where("error is null").select("chunk_id", "embedding")
