"""Removal of word sequences that documents with smaller ids have, by suffix automata over shards of reference passages.

A window is `window` consecutive words. Each word that is covered by a window which also starts in a document with a smaller doc_id goes, all judged on the input.

Every document is a reference for those behind it, so that automata of the whole reference would be as large as the corpus, and broadcasting each shard's to all documents would take work that grows with its square. Here shards are
cut by content instead. Each window picks the least-hashed of its GRAM-word grams as its anchor, so that equal windows pick equal anchors; consecutive windows with the anchor at the same place form a segment. Only
anchors that occur in different documents matter. Their segments, copies summed up, meet by anchor; in each shard they are streamed in the order of their smallest document: each gets its
matching statistics against the automaton of the segments of smaller documents, whose matches of at least `window` words are the maximal spans to remove, and is then added to it.

Documents with equal word sequences are one class, of which only the smallest is looked at: all words of the others go (if they have a window at all). Grams that occur in a large share of
a sample of the documents are hot: they become anchors only of windows all of whose grams are hot, and such windows are segments of their own, keyed by all their words. The sample decides on the way only, and not on results.

Segments that hold more than 1/MANY of all places are broadcast with what was found in them, so that tasks settle their places where they meet them and pass on runs of windows: a passage that many documents share, or repeat, takes rows
as the documents it is in, and not as its windows there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm._shared import hot_join, lean, written
from skein.llm._words import SPACED, Words, mix, signed, words_of

WINDOW, GRAM = 13, 7
#: Grams of fewer bytes, mostly of common words, become anchors only where there are no others. One byte counts between two words, whatever white space is there.
LONG_GRAM = 34
SAMPLE, HOT, HOT_KEYS = 64, 16, 100_000
MANY = 10_000
_LAST = 2**63 - 1


class Automaton:
    """The suffix automaton of several word sequences."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, edges: dict[bytes, int], link: int) -> int:
        self.length.append(length)
        self.next.append(edges)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """A copy of q for the sequences that end a step behind p."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[bytes]) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
            last = new

    def matching(self, words: list[bytes]) -> list[int]:
        """For each word the length of the longest sequence that ends with it and is in the automaton."""
        out, state, length = [], 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            out.append(length)
        return out


def _among(keys: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which keys are in hot, which is sorted."""
    if not len(hot) or not len(keys):
        return np.zeros(len(keys), bool)
    return hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys


def _segments(w: Words, k: int, h: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchor, the first and the last window of each segment, for words with hashes h."""
    gram = min(GRAM, k)
    grams = w.window_hashes(h, gram)
    n = len(h)
    if n < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    rank = grams >> np.uint64(2)
    rank |= _among(signed(grams), hot).astype(np.uint64) << np.uint64(63)
    letters = np.concatenate(([0], np.cumsum(w.ends - w.starts)))
    rank[: n - gram + 1] |= (letters[gram:] - letters[: n - gram + 1] + gram - 1 < LONG_GRAM).astype(np.uint64) << np.uint64(62)
    windows = n - k + 1
    best, at = rank[:windows].copy(), np.arange(windows)
    for j in range(1, k - gram + 1):
        other = rank[j : j + windows]
        less = other < best
        best[less] = other[less]
        at[less] = np.flatnonzero(less) + j
    valid = w.inside(k)[:windows]
    begins = valid.copy()
    begins[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    ends = valid.copy()
    ends[:-1] &= (at[1:] != at[:-1]) | ~valid[1:]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    return grams[at[first]], first, last


def _class(w: Words, d: int) -> bytes:
    return hashlib.sha256(w.joined(int(w.bounds[d]), int(w.bounds[d + 1]))).digest()


def _number(digest: bytes) -> int:
    """A class as a number, even: the lowest bit is used for a mark."""
    return int.from_bytes(digest[:8], "little", signed=True) & ~1


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, digest = [], []
        for w in words_of(batch.column(2), SPACED):
            n.append(w.counts)
            digest += [_class(w, d) for d in range(w.hi - w.lo)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(n) if n else np.empty(0, np.int64), pa.int64()), pa.array(digest, pa.binary()), pa.array([_number(x) for x in digest], pa.int64())], names=["doc_id", "text_hash", "n_words", "all_words", "class"])


def _grams(k: int):
    """key and class of each gram of the texts that have a window."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words_of(batch.column(0), SPACED):
                gram = min(GRAM, k)
                grams, doc, inside = w.window_hashes(w.hashes(), gram), w.doc_of_word(), w.inside(gram)
                long = w.counts >= k
                keep = inside & long[doc] if len(doc) else inside
                classes = np.array([_number(_class(w, d)) if long[d] else 0 for d in range(w.hi - w.lo)], np.int64)
                pairs = np.unique(np.column_stack([signed(grams[keep]), classes[doc[keep]]]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["key", "class"])

    return work


def _anchored(k: int, hot):
    """key and class of each segment of each text. Segments with a hot anchor are marked in the class' lowest bit, and spread over keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words_of(batch.column(0), SPACED):
                anchor, first, _ = _segments(w, k, w.hashes(), hot.value)
                classes = np.array([_number(_class(w, d)) if w.bounds[d + 1] - w.bounds[d] >= k else 0 for d in range(w.hi - w.lo)], np.int64)
                key, own = signed(anchor), classes[w.doc_of_word()[first]]
                mark = _among(key, hot.value)
                key = np.where(mark, key ^ own, key)
                own = own | mark
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own)], names=["key", "class"])

    return work


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and class those whose key has several classes; the key of marked rows is null."""
    held_key, held_own = np.empty(0, np.int64), np.empty(0, np.int64)

    def found(key, own):
        mark = own & 1 == 1
        key, own, marked = key[~mark], own[~mark], np.unique(own[mark] - 1)
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        sizes = np.diff(np.append(at, len(key)))
        several = np.minimum.reduceat(own, at) != np.maximum.reduceat(own, at) if len(at) else np.empty(0, bool)
        keep = np.repeat(several, sizes)
        key, own = key[keep], own[keep]
        return pa.RecordBatch.from_arrays([pa.array(np.append(own, marked)), pa.concat_arrays([pa.array(key, pa.int64()), pa.nulls(len(marked), pa.int64())])], names=["class", "anchor"])

    for batch in batches:
        key, own = np.append(held_key, batch.column(0).to_numpy()), np.append(held_own, batch.column(1).to_numpy())
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
        if cut:
            yield found(key[:cut], own[:cut])
        held_key, held_own = key[cut:], own[cut:]
        new = np.append(True, held_own[1:] != held_own[:-1])  # each class once is enough
        held_key, held_own = held_key[new], held_own[new]
    if len(held_key):
        yield found(held_key, held_own)


def _picked(w: Words, k: int, anchors: list[list[int] | None], hot: np.ndarray):
    """The text, key, hash, first word and end of each segment whose anchor is shared (by text) or hot; of hot anchors each window is a segment of its own, keyed by its words."""
    h = w.hashes()
    anchor, first, last = _segments(w, k, h, hot)
    doc = w.doc_of_word()[first]
    key = signed(anchor)
    owner = np.repeat(np.arange(len(anchors)), [len(a or ()) for a in anchors])
    own = np.array([x for a in anchors for x in a or ()], np.int64)
    paired = lambda d, x: mix(x.astype(np.int64).view(np.uint64) ^ mix(d.astype(np.uint64)))
    is_hot = _among(key, hot)
    is_shared = np.isin(paired(doc, key), paired(owner, own)) & ~is_hot
    sizes = (last - first + 1)[is_hot]
    window = np.repeat(first[is_hot] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
    start = np.concatenate([first[is_shared], window])
    end = np.concatenate([last[is_shared], window]) + k
    seg = signed(w.range_hashes(h, start, end))
    return np.concatenate([doc[is_shared], np.repeat(doc[is_hot], sizes)]), np.concatenate([key[is_shared], seg[is_shared.sum() :]]), seg, start, end


def _emitted(k: int, hot):
    """Rows of (class, ord, text, anchors) as segments: key, seg, words, ord, and the number of places of the batch that it stands for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ords = batch.column("ord").to_numpy()
            anchors = batch.column("anchors").to_pylist()
            for w in words_of(batch.column("text"), SPACED):
                doc, key, seg, start, end = _picked(w, k, anchors[w.lo : w.hi], hot.value)
                ord_ = ords[w.lo + doc]
                order = np.lexsort((ord_, seg, key))
                key, seg, ord_, start, end = (x[order] for x in (key, seg, ord_, start, end))
                at = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (seg[1:] != seg[:-1]))) if len(key) else np.empty(0, np.int64)
                words = [w.joined(a, b) for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(seg[at]), pa.array(words, pa.binary()), pa.array(ord_[at]), pa.array(np.diff(np.append(at, len(key))), pa.int64())], names=["key", "seg", "words", "ord", "n"])

    return work


class Known:
    """Segments of many places (key, seg, least, found), for the tasks that meet these places."""

    def __init__(self, rows: list[tuple[int, int, int, bytes]]):
        rows = sorted(rows, key=lambda r: r[1])
        self.key, self.seg, self.least = (np.array([r[c] for r in rows], np.int64) for c in range(3))
        self.bits = np.unpackbits(np.frombuffer(b"".join(r[3] for r in rows), np.uint8)).astype(bool)
        self.first = 8 * np.cumsum([0, *(len(r[3]) for r in rows)])[:-1]

    def place(self, key: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the segments given are known, and as which."""
        if not len(self.seg):
            return np.zeros(len(seg), bool), np.zeros(len(seg), np.int64)
        at = np.minimum(np.searchsorted(self.seg, seg), len(self.seg) - 1)
        return (self.seg[at] == seg) & (self.key[at] == key), at

    def windows(self, at: np.ndarray, ord_: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The windows found, in order, of the known segments at, which begin with the words start of documents ord_ and have n windows."""
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        found = np.repeat(ord_ > self.least[at], n) | self.bits[np.repeat(self.first[at], n) + step]
        return np.sort((np.repeat(start, n) + step)[found])


def _placed(k: int, hot, known):
    """Rows of (class, ord, text, anchors) as places of segments: class, ord, key, seg, first word, number of windows. In place of known segments come runs of the windows found in them, without key and seg."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, ords = (batch.column(c).to_numpy() for c in ("class", "ord"))
            anchors = batch.column("anchors").to_pylist()
            for w in words_of(batch.column("text"), SPACED):
                doc, key, seg, start, end = _picked(w, k, anchors[w.lo : w.hi], hot.value)
                n = end - start - k + 1
                settled, at = known.value.place(key, seg)
                window = known.value.windows(at[settled], ords[w.lo + doc[settled]], start[settled], n[settled])
                of = w.doc_of_word()[window]
                begins = np.flatnonzero(np.append(True, (window[1:] != window[:-1] + 1) | (of[1:] != of[:-1]))) if len(window) else np.empty(0, np.int64)
                doc, start, n = (np.append(x[~settled], y) for x, y in ((doc, of[begins]), (start, window[begins]), (n, np.diff(np.append(begins, len(window))))))
                none = pa.nulls(len(begins), pa.int64())
                columns = [classes[w.lo + doc], ords[w.lo + doc], *(pa.concat_arrays([pa.array(x[~settled], pa.int64()), none]) for x in (key, seg)), start - w.bounds[doc], n]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["class", "ord", "key", "seg", "first", "n_windows"])

    return work


def _streamed(k: int):
    """Segments sorted by key and least document, each matched against the automaton of those of smaller documents: the windows found."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, key, waiting, waiting_for = None, None, [], None
        for batch in batches:
            found = []
            for x, words, least in zip(*(batch.column(c).to_pylist() for c in ("key", "words", "least")), strict=True):
                words = words.split(b" ")
                if x != key:
                    automaton, key, waiting, waiting_for = None, x, [], least
                if least != waiting_for:
                    automaton = automaton or Automaton()
                    for other in waiting:
                        automaton.add(other)
                    waiting, waiting_for = [], least
                waiting.append(words)  # a document isn't a reference for itself
                hit = [m >= k for m in automaton.matching(words)[k - 1 :]] if automaton else [False] * (len(words) - k + 1)
                found.append(np.packbits(hit).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("seg"), batch.column("least"), batch.column("n"), pa.array(found, pa.binary())], names=["key", "seg", "least", "n", "found"])

    return work


def _spanned(k: int):
    """Rows of (class, text, covers) with the kept text, its words joined by one space as a hash, and the number of words removed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            covers, out = batch.column(batch.schema.get_field_index("covers")).to_pylist(), []
            for w in words_of(batch.column(batch.schema.get_field_index("text")), SPACED):
                for d in range(w.hi - w.lo):
                    a, b = int(w.bounds[d]), int(w.bounds[d + 1])
                    edge = np.zeros(b - a + 1, np.int64)
                    ons, offs = [], []
                    for c in covers[w.lo + d]:
                        if c["found"] is None:  # all its windows
                            ons.append(c["first"])
                            offs.append(c["first"] + c["n_windows"] - 1 + k)
                        else:
                            hit = np.flatnonzero(np.unpackbits(np.frombuffer(c["found"], np.uint8), count=c["n_windows"])) + c["first"]
                            ons += hit.tolist()
                            offs += (hit + k).tolist()
                    np.add.at(edge, ons, 1)
                    np.add.at(edge, offs, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    cut = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                    left, pieces, kept = int(w.offsets[d]), [], []
                    i = a
                    for s, e in zip(cut[::2].tolist(), cut[1::2].tolist(), strict=True):
                        pieces.append(w.data[left : w.starts[a + s]].tobytes())
                        kept.append(w.joined(i, a + s))
                        i, left = a + e, int(w.starts[a + e]) if a + e < b else int(w.ends[b - 1])
                    pieces.append(w.data[left : int(w.offsets[d + 1])].tobytes())
                    kept.append(w.joined(i, b))
                    out.append((int(gone.sum()), hashlib.sha256(b" ".join(x for x in kept if x)).digest(), b"".join(pieces).decode()))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("class")), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.string()), strict=True))], names=["class", "n_removed", "kept_words", "kept_text"])

    return work


def removals(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Two tables: rows (doc_id, ord, n_words, all_words, class), one for each row of docs, and classes (class, least, n, n_removed, kept_words, kept_text).

    least is the smallest ord of a class, that is doc_id with null behind all others. Rows with a larger ord lose all words if they have a window; for the others n_removed and kept_* are null if nothing goes.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    rows = written(texts.mapInArrow(lean(_described), "doc_id bigint, text_hash bigint, n_words bigint, all_words binary, class bigint").withColumn("ord", F.coalesce("doc_id", F.lit(_LAST))), "described")
    first = F.min(F.struct("ord", "text_hash"))
    classes = rows.groupBy("class").agg(first.alias("first"), F.count(F.lit(1)).alias("n"), F.max("n_words").alias("n_words"))
    classes = written(classes.select("class", F.col("first.ord").alias("least"), F.col("first.text_hash").alias("text_hash"), "n", "n_words"), "classes")
    rows = rows.drop("text_hash")
    empty = np.empty(0, np.int64)

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(lean(_grams(window)), "key bigint, class bigint").distinct()
    some = written(some, "sample")
    least = max(HOT, some.count() // HOT_KEYS)
    hot = some.groupBy("key").count().where(F.col("count") >= least).select("key").toPandas()["key"].to_numpy(np.int64)  # no more than HOT_KEYS
    hot = spark.sparkContext.broadcast(np.sort(hot) if len(hot) else empty)

    keyed = texts.select("text").mapInArrow(lean(_anchored(window, hot)), "key bigint, class bigint")
    shared = keyed.repartition("key").sortWithinPartitions("key", "class").mapInArrow(lean(_shared), "class bigint, anchor bigint")
    shared = shared.groupBy("class").agg(F.collect_set("anchor").alias("anchors"))  # a document's at most
    needed = written(classes.select("class", F.col("least").alias("ord"), "text_hash").join(shared, "class"), "shared")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts that are of the class they were joined to, each class once: all rows of an ord and text are in one task."""
        done: set[int] = set()
        for batch in batches:
            same = [_number(_class(w, d)) for w in words_of(batch.column(batch.schema.get_field_index("text")), SPACED) for d in range(w.hi - w.lo)]
            keep = []
            for a, b in zip(same, batch.column(batch.schema.get_field_index("class")).to_pylist(), strict=True):
                keep.append(a == b and b not in done)
                done.update([b] if keep[-1] else [])
            yield batch.filter(pa.array(keep, pa.bool_()))

    found = texts.select(F.coalesce("doc_id", F.lit(_LAST)).alias("ord"), "text_hash", "text").repartition("ord", "text_hash")  # rows without an id, or with a repeated one, are told apart by their texts
    found = found.join(needed.repartition("ord", "text_hash").hint("shuffle_hash"), ["ord", "text_hash"]).select("class", "ord", "text", "anchors")
    found = written(found.mapInArrow(lean(own), found.schema), "involved")

    segments = found.mapInArrow(lean(_emitted(window, hot)), "key bigint, seg bigint, words binary, ord bigint, n bigint").groupBy("key", "seg").agg(F.first("words").alias("words"), F.min("ord").alias("least"), F.sum("n").alias("n"))
    matched = segments.repartition("key").sortWithinPartitions("key", "least").mapInArrow(lean(_streamed(window)), "key bigint, seg bigint, least bigint, n bigint, found binary")
    matched = written(matched, "matched")
    total = matched.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = matched.where(F.col("n") * MANY > total).select("key", "seg", "least", "found").collect()  # fewer than MANY
    known = spark.sparkContext.broadcast(Known([(r["key"], r["seg"], r["least"], bytes(r["found"])) for r in known]))
    places = written(found.mapInArrow(lean(_placed(window, hot, known)), "class bigint, ord bigint, key bigint, seg bigint, first bigint, n_windows bigint"), "places")
    covers = places.where("key is not null").join(matched, ["key", "seg"]).withColumn("found", F.when(F.col("ord") <= F.col("least"), F.col("found"))).where(F.col("found").isNull() | (F.regexp_replace(F.hex("found"), "0", "") != ""))
    covers = covers.select("class", "first", "n_windows", "found").unionByName(places.where("key is null").select("class", "first", "n_windows", F.lit(None).cast("binary").alias("found")))
    covers = covers.groupBy("class").agg(F.collect_list(F.struct("first", "n_windows", "found")).alias("covers"))  # a document's
    changed = found.select("class", "text").join(covers, "class").mapInArrow(lean(_spanned(window)), "class bigint, n_removed bigint, kept_words binary, kept_text string")
    return rows, classes.drop("text_hash").join(written(changed, "changed"), "class", "left")


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    rows, classes = removals(docs, window)
    out = hot_join(rows.drop("n_words"), classes, ["class"], rows.count())
    copy = (F.col("ord") > F.col("least")) & (F.col("n_words") >= window)
    none = F.sha2(F.lit(""), 256)
    return out.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(copy, none).otherwise(F.lower(F.hex(F.coalesce("kept_words", "all_words")))).alias("kept_sha256"),
    )


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the words that are to go cut from the texts; texts that lose all their words are empty. Null texts stay."""
    rows, classes = removals(docs, window)
    total = rows.count()
    names = {"class": "__class", "least": "__least", "n": "__n", "n_words": "__n_words", "kept_text": "__kept_text"}
    classes = classes.where("n_removed is not null or n > 1").select(*(F.col(c).alias(x) for c, x in names.items()))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            own = [_number(_class(w, d)) for w in words_of(batch.column(at), SPACED) for d in range(w.hi - w.lo)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], names=[*batch.schema.names, "__class"])

    marked = docs.mapInArrow(lean(named), T.StructType([*docs.schema.fields, T.StructField("__class", T.LongType())]))
    hot = F.broadcast(classes.where(F.col("__n") * 10_000 > total))  # fewer than 10,000
    cold = marked.join(hot.select("__class"), "__class", "left_anti").join(classes.where(F.col("__n") * 10_000 <= total), "__class", "left")
    both = marked.join(hot, "__class").unionByName(cold)
    copy = (F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)) > F.col("__least")) & (F.col("__n_words") >= window)
    text = F.when(F.col("text").isNotNull() & F.col("__least").isNotNull(), F.when(copy, F.lit("")).otherwise(F.coalesce("__kept_text", "text"))).otherwise(F.col("text"))
    return both.select(*(text.alias("text") if c == "text" else F.col(c) for c in docs.columns))


ORACLE_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
places AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM words, unnest(range(1, greatest(1, len(ws) - 11))) AS u(i)),
firsts AS (SELECT win, min(doc_id) AS first_id FROM places GROUP BY win),
gone AS (SELECT DISTINCT p.doc_id, i + j AS k FROM places p JOIN firsts f ON p.win = f.win AND f.first_id < p.doc_id, unnest(range(0, 13)) AS u(j)),
kept AS (SELECT w.doc_id, count(*) AS n, string_agg(w.word, ' ' ORDER BY w.k) AS words FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM words) w ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.k = w.k GROUP BY w.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256 FROM words w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""
