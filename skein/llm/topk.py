"""Exact top-k search by a pivot-distance index.

Each vector is keyed by its nearest pivot and its distance from it. A range partitioning by (pivot, distance, row) puts neighbouring distances together and splits any hot value; each partition is cut into
blocks, the annuli, of at most BLOCK vectors of one pivot. Queries first search the annulus that they lie in, which gives a lower bound of their k-th score. From the triangle inequality a vector at distance r
from a pivot is at least |d(q, pivot) - r| from the query, so that with |x|^2 <= N it scores at most (|q|^2 + N - lower^2) / 2. So a query needs no more of a pivot's vectors than those in a range of distances; queries and
annuli meet by pivot and SLICES equal slices of its distances, only where these ranges do, and only annuli whose limit reaches the bound are expanded, in the order of that
limit. A task stops a query's expansion as soon as its k-th score is above the limit of what is left.

Vectors are turned into integers floor(scale * x); scores are exact integer inner products, as long as a long holds them, and the ends of its range otherwise. The pivots come from a bounded sample, more of them for larger
tables (the square root of the number of rows, PIVOTS[0] to PIVOTS[1]); any pivots give right results. Vectors of a length of FAR and more have no useful distances: they form annuli that every query expands, and expand all as queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm._shared import row_at, written

PIVOTS, SAMPLE, BLOCK, SCALE = (32, 1024), 2048, 1024, 1024
SLICES = 64
FAR = 1e100
_QUERIES = 512
_NONE, _MOST = -(2**63), 2**63 - 1
#: Slack for rounding in distances; only ever lets more annuli in.
_SLACK = 1e-6


def _matrix(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, which a double holds exactly; components that a row lacks are 0."""
    lengths = column.value_lengths().to_numpy()
    out = np.zeros((len(lengths), dims))
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(scale * column.flatten().to_numpy(zero_copy_only=False)), -np.finfo(float).max, np.finfo(float).max)
    out[np.arange(dims) < lengths[:, None]] = whole
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows, exact, and then cut to a long's range."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    whole = lambda m: [[int(x) for x in row] for row in m]
    right = whole(b)
    return np.array([[min(_MOST, max(_NONE, sum(x * y for x, y in zip(p, q, strict=True)))) for q in right] for p in whole(a)], np.int64).reshape(len(a), len(b))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), len(b)))
    for j in range(len(b)):  # not by a product: that would lose digits
        out[:, j] = np.sqrt(((a - b[j]) ** 2).sum(axis=1))
    return out


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """A few rounds of k-means, from the points that lie furthest from those taken."""
    distinct = np.unique(sample, axis=0).astype(np.float64)
    taken = [0]
    nearest = ((distinct - distinct[0]) ** 2).sum(axis=1)
    while len(taken) < min(n, len(distinct)):
        taken.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((distinct - distinct[taken[-1]]) ** 2).sum(axis=1))
    centres = distinct[taken]
    for _ in range(5):
        own = _distances(distinct, centres).argmin(axis=1)
        centres = np.array([distinct[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
    return centres


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        if len(some) > 4 * k:  # many ties: the smallest ids of those on the edge
            edge = some[scores[some] == least]
            edge = edge[np.argpartition(ids[edge], k)[:k]] if len(edge) > k else edge
            some = np.concatenate([some[scores[some] > least], edge])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], ~scores[some]))[:k]]  # ~: the negative of a long's least value is itself


def search(vectors: DataFrame, every: int = 100, k: int = 10, id_column: str = "vec_id", vector: str = "embedding", scale: int = SCALE, pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every` the k rows with the highest scores but its own, ties to smaller ids; fewer if there are fewer rows.

    Rows that share an id are rows of their own. Rows without id take no part, nor do vectors that are null or hold null or non-finite components. A vector that is shorter than others counts as if zeros followed. Other columns of
    the table, whatever their names, have no part in it.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    rows = row_at(rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))), "row")
    total, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not total:
        return spark.createDataFrame([], schema)
    pivots = pivots or min(PIVOTS[1], max(PIVOTS[0], math.isqrt(total)))
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(max(SAMPLE, 4 * pivots)).select("v").collect()]
    sample = _matrix(pa.array(sample, pa.list_(pa.float64())), dims, scale)
    sample = sample[(np.abs(sample) < FAR / max(1, dims)).all(axis=1)]
    centres = _pivots(sample, pivots) if len(sample) else np.zeros((1, dims))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(2), dims, scale)
            near = (np.abs(v) < FAR / max(1, dims)).all(axis=1)
            own, dist = np.full(len(v), -1, np.int32), np.zeros(len(v))
            d = _distances(v[near], centres)
            own[near] = d.argmin(axis=1)
            dist[near] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own), pa.array(dist), pa.array([x.tobytes() for x in v], pa.binary())], names=["row", "vec_id", "pivot", "dist", "v"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Annuli of sorted rows, and the bound that each query among them gets from its own annulus."""
        def one(row, ids, pivot, dist, v):
            asked = np.flatnonzero(ids % every == 0)
            least = []
            scores = _products(v[asked], v)
            for q, i in enumerate(asked.tolist()):
                others = np.delete(scores[q], i)
                least.append(int(np.partition(others, len(others) - k)[len(others) - k]) if len(others) >= k else _NONE)
            square = float((v * v).sum(axis=1).max()) if pivot >= 0 else math.inf
            queries = [{"query": int(row[i]), "query_id": int(ids[i]), "least": m, "q": v[i].tobytes()} for i, m in zip(asked.tolist(), least, strict=True)]
            return {"pivot": pivot, "near": float(dist[0]), "far": float(dist[-1]), "square": square, "rows": row.astype("<i8").tobytes(), "ids": ids.astype("<i8").tobytes(), "vectors": v.tobytes(), "queries": queries}

        asked_kind = pa.struct([("query", pa.int64()), ("query_id", pa.int64()), ("least", pa.int64()), ("q", pa.binary())])
        kinds = pa.schema([("pivot", pa.int32()), ("near", pa.float64()), ("far", pa.float64()), ("square", pa.float64()), ("rows", pa.binary()), ("ids", pa.binary()), ("vectors", pa.binary()), ("queries", pa.list_(asked_kind))])
        held: list[tuple] = []

        def cut(last: bool):
            nonlocal held
            if not held:
                return
            row, ids, pivot, dist, v = (np.concatenate([h[i] for h in held]) for i in range(5))
            a = 0
            while a < len(ids):
                end = a + int(np.searchsorted(pivot[a:], pivot[a], "right"))
                b = min(end, a + BLOCK)
                if b == len(ids) and not last and b - a < BLOCK:
                    break
                yield pa.RecordBatch.from_pylist([one(row[a:b], ids[a:b], int(pivot[a]), dist[a:b], v[a:b])], kinds)
                a = b
            held = [(row[a:], ids[a:], pivot[a:], dist[a:], v[a:])] if a < len(ids) else []

        for batch in batches:
            v = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.float64).reshape(len(batch), dims)
            held.append((*(batch.column(i).to_numpy() for i in range(4)), v))
            if sum(len(h[0]) for h in held) >= 4 * BLOCK:
                yield from cut(False)
        yield from cut(True)

    index = rows.select("row", "vec_id", "v").mapInArrow(keyed, "row bigint, vec_id bigint, pivot int, dist double, v binary")
    index = index.repartitionByRange("pivot", "dist", "row").sortWithinPartitions("pivot", "dist", "row")
    index = index.mapInArrow(blocks, "pivot int, near double, far double, square double, rows binary, ids binary, vectors binary, queries array<struct<query:bigint,query_id:bigint,least:bigint,q:binary>>")
    index = written(row_at(index, "block"), "annuli")

    # at most a row for each pivot: a slice's width, the pivot's farthest vector, its longest one
    ends = {p: (max(far / SLICES, 1e-9), far, square) for p, far, square in index.groupBy("pivot").agg(F.max("far"), F.max("square")).collect()}
    asked = index.select(F.explode("queries").alias("x")).select("x.*")
    n_queries = asked.count()

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each query and pivot the slices in which vectors may be that reach the query's bound."""
        for batch in batches:
            q = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.float64).reshape(len(batch), dims)
            far_away = ~(np.abs(q) < FAR / max(1, dims)).all(axis=1)
            least = batch.column(2).to_numpy().astype(np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                square = np.where(far_away, math.inf, (q * q).sum(axis=1))
                d = np.where(far_away[:, None], 0, _distances(q, centres))
            for p, (width, far, most) in ends.items():
                own = d[:, p] if p >= 0 else np.zeros(len(q))
                left = square + most - 2 * least + (np.abs(square) + most + np.abs(least)) * _SLACK * 4 + 4
                radius = np.where(np.isfinite(left), np.sqrt(np.maximum(left, 0)), math.inf) * (1 + 2 * _SLACK) + 1e-6
                use = np.flatnonzero((left >= 0) & (own - radius <= far))
                first = np.clip(np.floor((own[use] - radius[use]) / width), 0, SLICES).astype(np.int32)
                last = np.clip(np.floor((own[use] + radius[use]) / width), 0, SLICES).astype(np.int32)
                some = batch.take(pa.array(use))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(2), pa.array(square[use]), pa.array(np.full(len(use), p, np.int32)), pa.array(own[use]), pa.array(first), pa.array(last)],
                    names=["query", "least", "q_square", "pivot", "d", "first", "last"],
                )

    reached = asked.mapInArrow(reach, "query bigint, least bigint, q_square double, pivot int, d double, first int, last int")
    widths = spark.createDataFrame([(p, w) for p, (w, _, _) in ends.items()], "pivot int, width double")
    in_slice = lambda x: F.least(F.lit(SLICES), F.floor(F.col(x) / F.col("width"))).cast("int")
    rings = index.select("block", "pivot", "near", "far", "square").join(F.broadcast(widths), "pivot").withColumn("from", in_slice("near")).withColumn("to", in_slice("far"))
    rings = rings.withColumn("slice", F.explode(F.sequence("from", "to")))
    lower = F.greatest(F.lit(0.0), F.col("near") - F.col("d"), F.col("d") - F.col("far")) * (1 - _SLACK)
    limit = (F.col("q_square") + F.col("square") - lower * lower) / 2 + (F.col("q_square") + F.col("square")) * _SLACK + 1
    # rings are no more than SLICES + 1 rows a pivot and one a block; queries' slices are many times those, and Spark, which sizes them as if nothing had been exploded, would take them for the smaller side
    pairs = reached.withColumn("slice", F.explode(F.sequence("first", "last"))).join(F.broadcast(rings), ["pivot", "slice"])
    pairs = pairs.where(F.col("slice") == F.greatest("first", "from"))  # the first slice that a query and an annulus share
    pairs = pairs.withColumn("limit", limit).where(F.col("limit") >= F.col("least").cast("double")).select("query", "block", "limit")
    parts = max(1, -(-n_queries // _QUERIES))
    pairs = pairs.join(asked, "query").withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)))
    pairs = pairs.groupBy("block", "part").agg(F.collect_list(F.struct("query", "query_id", "least", "limit", "q")).alias("queries"))  # about _QUERIES at most: queries are rows of their own, hashed

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[int]] = {}  # the k best scores that this task has seen, by query
        for batch in batches:
            for own, ids, vectors, queries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, ids, v = np.frombuffer(own, "<i8"), np.frombuffer(ids, "<i8"), np.frombuffer(vectors, np.float64)
                v = v.reshape(len(ids), dims)
                going = [x for x in queries if x["limit"] >= max(x["least"], known[x["query"]][0] if len(known.get(x["query"], ())) == k else _NONE)]
                if not going:
                    continue
                scores = _products(np.frombuffer(b"".join(x["q"] for x in going), np.float64).reshape(len(going), dims), v)
                out: list[list] = [[], [], [], []]
                for x, row in zip(going, scores, strict=True):
                    some = np.flatnonzero((row >= x["least"]) & (own != x["query"]))
                    some = some[_best(ids[some], row[some], k)]
                    best = row[some].tolist()
                    out[0] += [x["query"]] * len(some)
                    out[1] += [x["query_id"]] * len(some)
                    out[2] += ids[some].tolist()
                    out[3] += best
                    known[x["query"]] = sorted(known.get(x["query"], []) + best)[-k:]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query", "query_id", "vec_id", "score"])

    # all vectors are never broadcast, however small their files are: equal ones take next to nothing there
    found = pairs.join(index.select("block", "rows", "ids", "vectors").hint("merge"), "block").select("rows", "ids", "vectors", F.array_sort("queries", lambda a, b: F.when(a["limit"] > b["limit"], -1).when(a["limit"] < b["limit"], 1).otherwise(0)).alias("queries"))
    found = found.mapInArrow(expand, "query bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.i, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.i <> c.i WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id) <= 10
"""
