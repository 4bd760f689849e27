"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set is its distinct word shingles, as 64-bit hashes. Documents with equal sets are one class; the rest works on classes. A sketch has T coordinates. In round i < T each element is thrown into a
coordinate picked by a hash of its own for that round; in rounds T to 2T - 1 all elements go to coordinate i - T, so that every coordinate gets filled. A coordinate keeps the least (round, hash)
it was given, and a set's rounds end when all its coordinates are full: sets of T log T elements and more take about one. Each coordinate agrees for two sets with their Jaccard similarity as probability, and the number
that agree is concentrated as for independent ones.

Candidates share a band of ROWS coordinates. First each class is tried against the smallest class of each of its bands, which joins groups of copies without forming their pairs. Then the bands whose classes still lie
in several components are dealt to tasks in pairs of blocks, with full sets. A task compares classes of different components by their sketches and then their sets, and gives only links that join two
components: a forest, with fewer links than the group has rows. Links are closed to components.

Chance: with T = 128 and ROWS = 4 a pair at similarity 0.8 shares no band with probability 5e-8, and agrees in fewer than 0.6 of T coordinates with about 1e-8 (tasks know coordinates by 8 bits, so that with 1e-8 a pair is left to a band that it doesn't share). Sets of fewer than 4 elements can't reach 0.8 with a different set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from skein.llm._graph import components
from skein.llm._shared import lean, row_at, written
from skein.llm._words import SPACED_LOWER, mix, signed, words_of

SHINGLE, SHARE = 5, 80
T, ROWS = 128, 4
#: Classes, and elements of their sets, of a block: two of them meet in a task.
BLOCK, ELEMENTS = 1024, 1_000_000
#: Sketches of candidates agree in at least the wanted share of T coordinates, less this.
SLACK = 0.2
BROADCAST_IDS = 500_000
HOT = 10_000
_FULL = np.uint64(2**64 - 1)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct k-word shingles; all its words as one if there are fewer; none without words."""
    for w in words_of(column, SPACED_LOWER):
        h = w.hashes()
        windows, inside = w.window_hashes(h, k), w.inside(k)
        doc = w.doc_of_word()[inside]
        windows = windows[inside]
        order = np.lexsort((windows, doc))
        windows, doc = windows[order], doc[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (windows[1:] != windows[:-1])
        windows, doc = windows[new], doc[new]
        at = np.searchsorted(doc, np.arange(w.hi - w.lo + 1))
        counts = w.counts
        for d in range(w.hi - w.lo):
            n = int(counts[d])
            if 0 < n < k:
                yield np.array([int(w.window_hashes(h, n)[w.bounds[d]])], np.uint64)
            else:
                yield windows[at[d] : at[d + 1]]


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The sketches of sets that aren't empty: len(sets) x T."""
    out = np.full((len(sets), T), _FULL, np.uint64)
    flat = out.reshape(-1)
    sizes = np.array([len(s) for s in sets], np.int64)
    elements = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    for i in range(2 * T):
        if not len(elements):
            break
        h = mix(elements + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        place = (h & np.uint64(T - 1)).astype(np.int64) if i < T else np.int64(i - T)
        value = (np.uint64(i) << np.uint64(56)) | (h >> np.uint64(8))
        np.minimum.at(flat, owner * T + place, value)
        if i < 8 or i % 8 == 7:
            going = (out == _FULL).any(axis=1)
            stay = going[owner]
            if not stay.all():
                elements, owner = elements[stay], owner[stay]
    return out


def bands(sketch: np.ndarray) -> np.ndarray:
    """A hash of each band: rows x (T / ROWS)."""
    parts = mix(sketch).reshape(len(sketch), T // ROWS, ROWS)
    out = np.broadcast_to(np.arange(T // ROWS, dtype=np.uint64)[None], parts.shape[:2]).copy()
    for j in range(ROWS):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, j])
    return out


def _scan(k: int, least: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, doc_id, digest, texts = batch.columns
            for a in range(0, len(batch), 500):
                part = texts.slice(a, 500)
                sets = list(shingle_sets(part, k))
                big = [i for i, s in enumerate(sets) if len(s) >= least]
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                made = sketches([sets[i] for i in big])
                own_bands, short = bands(made), (mix(made) & np.uint64(255)).astype(np.uint8)
                band_lists: list = [None] * len(sets)
                shorts: list = [None] * len(sets)
                for j, i in enumerate(big):
                    band_lists[i] = signed(own_bands[j])
                    shorts[i] = short[j].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [row.slice(a, 500), doc_id.slice(a, 500), digest.slice(a, 500), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(band_lists, pa.list_(pa.int64())), pa.array(shorts, pa.binary())],
                    names=["row", "doc_id", "text_hash", "n_shingles", "key", "bands", "sketch"],
                )

    return scan


def _estimated(pairs: DataFrame, sketch: DataFrame, share: int) -> DataFrame:
    """The pairs whose sketches agree enough."""

    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, T) for i in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= (share / 100 - SLACK) * T))

    with_b = pairs.join(sketch.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
    both = with_b.join(sketch.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a").select("a", "b", "sa", "sb")
    return both.mapInArrow(lean(agreeing), "a bigint, b bigint")


def _full_sets(needed: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """node and elements, its whole set, of needed (node, key, __id, __hash: a document of that class and its text's hash), from the texts. Rows without an id, or with one that is repeated, are told apart by their texts."""
    few = needed.count() <= BROADCAST_IDS

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in batches for i in range(0, len(b), 500)):
            made = list(shingle_sets(batch.column(2), k))
            same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == key for s, key in zip(made, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([signed(s) for s in made], pa.list_(pa.int64()))], names=["node", "elements"]).filter(pa.array(same, pa.bool_()))

    texts = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("__id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__hash"), "text").join(F.broadcast(needed) if few else needed, ["__id", "__hash"]).select("node", "key", "text")
    return texts.mapInArrow(lean(sets), "node bigint, elements array<bigint>").dropDuplicates(["node"])


def _verified(pairs: DataFrame, full: DataFrame, share: int) -> DataFrame:
    """The pairs with 100 * intersection >= share * union of their full sets."""
    with_b = pairs.join(full.select(F.col("node").alias("b"), F.col("elements").alias("eb")), "b")
    both = with_b.join(full.select(F.col("node").alias("a"), F.col("elements").alias("ea")), "a")
    common = F.size(F.array_intersect("ea", "eb"))
    return both.withColumn("common", common).where(100 * F.col("common") >= share * (F.size("ea") + F.size("eb") - F.col("common"))).select("a", "b")


def _forest(rows: pa.RecordBatch, share: int) -> list[tuple[int, int]]:
    """Links between the components of a group's rows: no more than join what can be joined within the group, fewer than there are rows.

    Pairs of one component, also of one that the links found so far have made, need no look. Others are compared if no earlier band has both, if their sketches agree enough, and then on their full sets. Of a
    group of two sides only pairs across are looked at.
    """
    node, comp, size, side, band = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("node", "comp", "n_shingles", "side", "band"))
    if len(node) < 2 or comp.min() == comp.max():
        return []
    sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, T)
    earlier = np.ascontiguousarray(sketch[:, : int(band[0]) * ROWS]).view(np.uint32)  # a band is ROWS bytes here
    lists = rows.column("elements")
    values, at = lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
    known, element = np.unique(values, return_inverse=True)
    marked = np.zeros(len(known), bool)
    root = np.unique(comp, return_inverse=True)[1]
    links = []
    two = side.min() != side.max()
    for i in range(len(node)):
        other = root != root[i]
        if two:
            if side[i]:
                continue
            other &= side != side[i]
        else:
            other[:i] = False
        other = np.flatnonzero(other)
        other = other[100 * np.minimum(size[other], size[i]) >= share * np.maximum(size[other], size[i])]
        if len(other) and earlier.shape[1]:
            other = other[~(earlier[other] == earlier[i]).any(axis=1)]
        if len(other):
            other = other[(sketch[other] == sketch[i]).sum(axis=1) >= (share / 100 - SLACK) * T]
        marked[element[at[i] : at[i + 1]]] = True
        for part in (other[k : k + 256] for k in range(0, len(other), 256)):
            part = part[root[part] != root[i]]
            for j in part.tolist():
                if root[j] == root[i]:
                    continue
                common = int(np.count_nonzero(marked[element[at[j] : at[j + 1]]]))
                if 100 * common >= share * (int(size[i]) + int(size[j]) - common):
                    links.append((int(max(node[i], node[j])), int(min(node[i], node[j]))))
                    root[root == root[j]] = root[i]
        marked[element[at[i] : at[i + 1]]] = False
    return links


def _forests(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[pa.RecordBatch]:
    """The links of each group of rows that are sorted by group."""
    held: list[pa.RecordBatch] = []

    def groups(last: bool):
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held.clear()
        group = rows.column("group").to_numpy()
        cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1])).tolist()
        for x, y in zip(cuts, [*cuts[1:], len(group)], strict=True):
            if y < len(group) or last:
                if links := _forest(rows.slice(x, y - x), share):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])
            else:
                held.append(rows.slice(x))

    for batch in batches:
        if len(batch):
            held.append(batch)
            if batch.column("group")[len(batch) - 1] != held[0].column("group")[0]:
                yield from groups(False)
    if held:
        yield from groups(True)


def _apart(in_bands: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """Rows of bands that hold several components, dealt to groups such that each pair of components' rows of a band meets in one.

    The band's largest component is cut into blocks of its own, of at most about BLOCK rows and ELEMENTS elements, and so is the rest. A group is a block of the rest (all pairs), two of them, or one of them and a
    block of the largest component: blocks of this one never meet each other, so that a large group of joined copies costs its size times the number of the few blocks that aren't part of it.
    """
    placed = in_bands.drop("n").join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")
    counts = placed.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("e"))
    mixed = counts.groupBy("band").agg(F.count(F.lit(1)).alias("comps"), F.sum("n").alias("n"), F.sum("e").alias("e"), F.max(F.struct("n", "comp", "e")).alias("main")).where("comps > 1 and n > 2")
    parts = lambda n, e: F.ceil(F.greatest(n / BLOCK, e / ELEMENTS, F.lit(1))).cast("int")
    mixed = mixed.select("band", "n", F.col("main.comp").alias("main"), parts(F.col("main.n"), F.col("main.e")).alias("mains"), parts(F.col("n") - F.col("main.n"), F.col("e") - F.col("main.e")).alias("rests"))
    rows = _hot_join(placed, mixed, "band", total).withColumn("in_main", F.col("comp") == F.col("main"))
    block = F.pmod(F.xxhash64("node"), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("rests"))).cast("int")
    rows = rows.withColumn("block", block).withColumn("block", F.when(F.col("in_main"), -1 - F.col("block")).otherwise(F.col("block")))
    met = F.sequence(F.when(F.col("in_main"), F.lit(0)).otherwise(-F.col("mains")), F.col("rests") - 1)  # blocks of the largest component are -1, -2, ...
    rows = rows.withColumn("other", F.explode(met))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return rows.select("node", "comp", "n_shingles", F.col("place").alias("band"), F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"), F.xxhash64("band", low, high).alias("group"))


def _hot_join(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join to rows of right, unique by key, that know the number n of their key's rows in left: keys of more than 1/HOT of all rows, fewer than HOT, are broadcast."""
    hot = F.broadcast(right.where(F.col("n") * HOT > total))
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(right.where(F.col("n") * HOT <= total), key))


def link(docs: DataFrame, shingle: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that can be reached over links) and kept, one row per row of docs (doc_id, text and others).

    Documents are linked if 100 * intersection >= share * union of their shingle sets. Without words (null and empty texts) the set is empty and linked with nothing. Rows with equal ids are rows of
    their own; kept is doc_id = component_id, and where no row of a component has an id, only its first row is kept.
    """
    same = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    out = _linked(row_at(docs.select("doc_id", "text"), "row"), shingle, share)
    return out.select("doc_id", "n_shingles", "component_id", F.when(F.col("component_id").isNull(), F.col("row") == F.col("first_row")).otherwise(same).alias("kept"))


def _linked(docs: DataFrame, shingle: int, share: int) -> DataFrame:
    """row, doc_id, n_shingles, component_id and first_row (of the component's rows with the smallest id, the one with the smallest row; null ids behind all others), for docs with a column row."""
    least = -(-share // (100 - share))
    rows = docs.select("row", F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    rows = written(rows.mapInArrow(lean(_scan(shingle, least)), "row bigint, doc_id bigint, text_hash bigint, n_shingles bigint, key binary, bands array<bigint>, sketch binary"), "sketched")
    total = rows.count()
    classes = rows.where("key is not null").groupBy("key").agg(F.min("row").alias("node"), F.min("doc_id").alias("doc_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "text_hash")).alias("best"), F.count(F.lit(1)).alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = written(classes, "classes")
    sketch = classes.where("sketch is not null").select("node", "sketch")
    members = classes.where("bands is not null").select("node", "n_shingles", F.posexplode("bands").alias("place", "band"))
    heads = written(members.groupBy("band").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1"), "heads")
    in_bands = written(_hot_join(members, heads, "band", total), "in-bands")
    stars = written(_estimated(in_bands.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct(), sketch, share), "stars")
    keys = classes.select("node", "key", F.coalesce("best.doc_id", F.lit(-(2**63))).alias("__id"), F.col("best.text_hash").alias("__hash"))
    needed = written(keys.join(stars.select(F.col("a").alias("node")).union(stars.select(F.col("b").alias("node"))).distinct(), "node"), "needed")
    edges = written(_verified(stars, written(_full_sets(needed, docs, shingle), "sets"), share), "edges")
    labels = components(edges)

    apart = written(_apart(in_bands.drop("head"), labels, total), "apart")
    needed = written(keys.join(apart.select("node").distinct(), "node"), "needed")
    full = written(_full_sets(needed, docs, shingle).join(sketch, "node"), "sets")
    more = apart.join(full, "node").repartition("group").sortWithinPartitions("group").mapInArrow(lean(lambda batches: _forests(batches, share)), "a bigint, b bigint")
    more = written(more.distinct(), "edges")
    if not more.isEmpty():
        labels = components(edges.unionByName(more))

    named = classes.select("node", "key", "doc_id", "best", "n").join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node"))
    named = written(named, "named")
    names = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.min("best")["row"].alias("first_row"), F.count(F.lit(1)).alias("n"))
    named = _hot_join(named.select("comp", "key", F.col("n").alias("rows")), names, "comp", total).select("key", F.col("rows").alias("n"), "component_id", "first_row")
    alone = rows.where("key is null").select("row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("row").alias("first_row"))
    repeated = _hot_join(rows.where("key is not null").select("row", "doc_id", "n_shingles", "key"), named, "key", total)
    return repeated.select("row", "doc_id", "n_shingles", "component_id", "first_row").unionByName(alone)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's links: 2-word shingles, similarity 0.8."""
    return link(docs, shingle=2, share=80)


def keep_one(docs: DataFrame, shingle: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """One row of docs of each component, with the columns of docs: the first of those with its smallest doc_id (null behind all others). Rows without words are linked with nothing, and stay."""
    rows = written(row_at(docs, "__row"), "numbered")
    gone = written(_linked(rows.select("doc_id", "text", F.col("__row").alias("row")), shingle, share).where("row <> first_row").select(F.col("row").alias("__row")), "gone")
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "__row", "left_anti").select(*docs.columns)


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(2, len(ws)) - 1], ' ') AS s FROM words, unnest(range(1, greatest(2, len(ws)))) AS u(i) WHERE len(ws) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common.n >= 80 * (x.n + y.n - common.n)),
reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
comp AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN comp ON node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""
