"""Whitening of embeddings: an exact centred scatter, cyclic Jacobi rotations on the driver, projection in tasks.

Components become whole numbers x = floor(scale * c) + shift. Spark sums them, then the products of what is left after the nearest whole number to each mean is taken off; tasks give whole numbers, summed as decimals, so
that the scatter is exact and the same for any partitioning. The driver takes off what is left of the means, exactly too, divides once, and rotates pairs of components until no off-diagonal entry matters next to its two
diagonal ones, which also gives small eigenvalues to many digits. What comes to the driver is d sums and d * (d + 1) / 2 products for d dimensions, whatever the number of rows. The matrix of the leading components is broadcast.

Defined cases: rows whose vector is null, or holds null or a number that isn't finite, are left out. Shorter vectors count as if zeros followed. Numbers of 2**43 and more, after scaling, count as that. A component without
variance (an eigenvalue of nothing but rounding) has no whitened form and is left out, so that equal vectors, a single one or an empty table give no components. Repeated rows give a row each, null ids are kept. Deviations beyond
a long's range are cut to its end. Columns of the input with a name of the result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm._shared import written

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
_LARGEST = float(2**43)
_LONG = 2**63 - 1
_SWEEPS = 64


@dataclass(frozen=True)
class Whitening:
    """n vectors with sums of x by dimension; eigenvalues of x's covariance, falling, without those that are nothing but rounding, their unit vectors as columns, and the sum of all eigenvalues."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    scale: int
    shift: int


def _whole(column: pa.Array, dims: int | None, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and floor(scale * c) of their entries; dims is the longest vector's where it isn't given."""
    lengths = pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    keep = column.is_valid().to_numpy(zero_copy_only=False) & (wrong[ends] == wrong[ends - lengths])
    kept = lengths[keep]
    out = np.zeros((len(kept), int(kept.max(initial=0)) if dims is None else dims), np.int64)
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(scale * values[np.repeat(keep, lengths)]), -_LARGEST, _LARGEST)
    out[np.arange(out.shape[1]) < kept[:, None]] = whole.astype(np.int64)
    return keep, out


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _sums(vector: str, scale: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(0, object)
        for batch in batches:
            _, z = _whole(batch.column(vector), None, scale)
            n += len(z)
            more = np.zeros(max(len(total), z.shape[1]), object)
            more[: len(total)] += total
            more[: z.shape[1]] += z.sum(axis=0).astype(object)
            total = more
        dims = pa.array(np.arange(-1, len(total), dtype=np.int32))  # -1: the number of vectors
        yield pa.RecordBatch.from_arrays([dims, _decimals([n, *total])], ["i", "v"])

    return sums


def _products(z: np.ndarray) -> np.ndarray:
    """Sums of products of columns, exact."""
    most = int(np.abs(z).max(initial=0))
    if most * most * len(z) < 2**53:
        f = z.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    if most * most * len(z) < 2**63:
        return (z.T @ z).astype(object)
    big = z.astype(object)
    return big.T @ big


def _scatter(vector: str, scale: int, less: np.ndarray):
    """Sums of products of floor(scale * c) - less."""

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(less), len(less)), object)
        for batch in batches:
            total += _products(_whole(batch.column(vector), len(less), scale)[1] - less)
        i, j = np.triu_indices(len(less))
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), _decimals(total[i, j])], ["i", "j", "v"])

    return scatter


def _rounds(d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of d (even) things, as d - 1 rounds of pairs without a common one."""
    ring = np.arange(1, d)
    for k in range(d - 1):
        turned = np.concatenate([[0], np.roll(ring, k)])
        a, b = turned[: d // 2], turned[d // 2 :][::-1]
        yield np.minimum(a, b), np.maximum(a, b)


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix, by sweeps over all pairs. Each vector's largest entry is positive."""
    d = len(matrix)
    a = np.zeros((d + d % 2, d + d % 2))  # a dimension of zeros makes the number even
    a[:d, :d] = matrix
    u = np.eye(len(a))
    eps = np.finfo(float).eps
    for _ in range(_SWEEPS if d > 1 else 0):
        moved = False
        for p, q in _rounds(len(a)):
            off = a[p, q]
            turn = np.abs(off) > eps * np.sqrt(np.abs(a[p, p] * a[q, q]))
            if not turn.any():
                continue
            moved = True
            p, q, off = p[turn], q[turn], off[turn]
            pp, qq = a[p, p], a[q, q]
            with np.errstate(over="ignore"):
                tau = (qq - pp) / (2 * off)
                t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.hypot(1.0, tau))
            c = 1 / np.hypot(1.0, t)
            s = t * c
            for m in (a, u):
                left, right = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * left - s * right, s * left + c * right
            left, right = a[p, :], a[q, :]
            a[p, :], a[q, :] = c[:, None] * left - s[:, None] * right, s[:, None] * left + c[:, None] * right
            a[p, p], a[q, q] = pp - t * off, qq + t * off
            a[p, q] = a[q, p] = 0.0
        if not moved:
            break
    values, vectors = np.diag(a)[:d], u[:d, :d]
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    if d:
        vectors = vectors / np.linalg.norm(vectors, axis=0)
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)
    return values, vectors


def fit(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> Whitening:
    """The covariance of all rows that take part, divided by their number, and its components."""
    rows = vectors.select(F.col(vector).alias("v"))
    found = rows.mapInArrow(_sums("v", scale), "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v")).collect()  # a row for each dimension
    sums = {r["i"]: int(r["v"]) for r in found}
    n, dims = sums.pop(-1, 0), len(sums)
    if not n or not dims:
        return Whitening(n, [], np.zeros(0), np.zeros((0, 0)), 0.0, scale, shift)
    mean = [(2 * sums[i] + n) // (2 * n) for i in range(dims)]  # the nearest whole number
    left = [sums[i] - n * mean[i] for i in range(dims)]
    parts = rows.mapInArrow(_scatter("v", scale, np.array(mean, np.int64)), "i int, j int, v decimal(38,0)")
    cov = np.zeros((dims, dims))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # d * (d + 1) / 2 rows
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = (n * int(r["v"]) - left[r["i"]] * left[r["j"]]) / (n * n)
    values, unit = jacobi(cov)
    real = values > dims * np.finfo(float).eps * values.max(initial=0.0)
    return Whitening(n, [sums[i] + n * shift for i in range(dims)], values[real], unit[:, real], float(np.trace(cov)), scale, shift)


def _project(vector: str, model, components: int):
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        sums = np.array([s - w.n * w.shift for s in w.sums], object)  # of floor(scale * c)
        mean = np.array([(2 * s + w.n) // (2 * w.n) for s in sums], np.int64)
        left = sums - w.n * mean
        near = left.astype(np.float64) / w.n
        matrix = w.vectors[:, :components] / np.sqrt(w.values[:components])
        for batch in batches:
            keep, z = _whole(batch.column(vector), len(sums), w.scale)
            z -= mean
            most = w.n * int(np.abs(z).max(initial=0)) + max((abs(int(x)) for x in left), default=0)
            if most * most * max(1, len(sums)) <= _LONG:
                y = z * w.n - left.astype(np.int64)
                deviation = (y * y).sum(axis=1)
            else:
                y = z.astype(object) * w.n - left
                deviation = np.array([min(_LONG, int(x)) for x in (y * y).sum(axis=1)], np.int64)
            white = (z - near) @ matrix
            rest = batch.filter(pa.array(keep)).drop_columns([vector])
            offsets = pa.array(np.arange(len(z) + 1, dtype=np.int32) * matrix.shape[1])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(deviation), pa.ListArray.from_arrays(offsets, pa.array(white.ravel()))], [*rest.schema.names, "deviation", "whitened"])

    return project


def whiten(vectors: DataFrame, model: Whitening, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """Rows that take part, without the vector, with deviation (the sum over dimensions of (n * x - sum) ** 2) and whitened, the leading components' values."""
    rest = [c for c in vectors.columns if c not in (vector, "deviation", "whitened")]
    schema = T.StructType([*(vectors.schema[c] for c in rest), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    rows = vectors.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{vector}`").alias("__vector"))
    if not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(_project("__vector", vectors.sparkSession.sparkContext.broadcast(model), components), schema)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0.0, None
    for batch in batches:
        if len(batch):
            w = batch.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            w = np.hstack([np.ones((len(w), 1)), w])
            total = w.T @ w if total is None else total + w.T @ w
    if total is not None:
        i, j = (x.ravel().astype(np.int32) for x in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "v"])


def identity_error(white: DataFrame) -> float:
    """The largest absolute entry of the covariance of whitened rows, less the identity; 0 without rows."""
    found = white.select("whitened").mapInArrow(_moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # components squared
    if not found:
        return 0.0
    d = 1 + max(r["i"] for r in found)
    m = np.zeros((d, d))
    for r in found:
        m[r["i"], r["j"]] = r["v"]
    mean = m[0, 1:] / m[0, 0]
    return float(np.abs(m[1:, 1:] / m[0, 0] - np.outer(mean, mean) - np.eye(d - 1)).max())


def digest(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each vector that takes part and each component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    vectors = vectors.select("vec_id", "embedding")
    model = fit(vectors)
    white = written(whiten(vectors, model, components), "whitened")
    error = identity_error(white)
    share = F.array(*(F.lit(float(v / model.trace)) for v in model.values[:components])) if len(model.values) else F.array(F.lit(0.0))
    rows = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", F.element_at(share, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error")
    )
