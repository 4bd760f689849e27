"""Language-model scoring by prediction by partial matching (PPM), with the counts of words beside it.

A text is begun by BEGIN bytes and ended by an END byte (neither occurs in UTF-8). The model of a given order has contexts of that many bytes down to none. A symbol's code length is its share at the longest context that has
seen it, times the escapes from the longer ones (method C: as many escapes as distinct symbols), where symbols already seen in a longer context are excluded from the shorter ones; a symbol that was never seen has its share of the
equally likely rest. A text's score is the sum over its bytes and the end.

Contexts of 2, 1 and 0 bytes: tasks count the byte triples of the training texts; Spark sums the counts. Counts of shorter contexts are sums of them. There are at most 2**24 triples whatever the corpus' size, so that they can be
brought to the driver and broadcast. Order 2 is these alone: a task turns them into a table of code lengths.

Longer contexts, whose number grows with the corpus, stay in Spark: texts travel in groups, and each group's distinct byte strings (context and symbol) with their training counts go to parts by the 3 bytes before the symbol. So a
part has all longer contexts that end with these 3 bytes: it sums the counts up, builds the tries of orders 3 and more, and gives each group the code lengths of its own strings, which meet the group's texts in another shuffle.

`adaptive` scores a text by a trie that starts empty and learns each byte after it is coded, with the same escapes and exclusions.

Words: the training counts are summed by hash in Spark. The words that make up more than 1/HEAVY of the training tokens each (fewer than HEAVY of them) are broadcast; other words of a text meet their counts in a shuffle by
hash, packed as one row for each input batch and part, so that no part holds a hot word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm._shared import lean, row_at, written
from skein.llm._words import CHUNK_BYTES, SPACED_LOWER, signed, texts_as_bytes, words_of

BEGIN, END = 0xFE, 0xFF
HEAVY = 1 << 16
#: Distinct words of a part at most, on average: a task holds one part's.
PART_WORDS = 1_000_000
#: Texts whose sums travel together.
_GROUP = 2000
_LEAVES = 1 << 24
#: Contexts of op6: five bytes.
ORDER = 5
#: Bytes of text whose strings travel together; bytes of text of which a part has the strings, on average.
GROUP_BYTES, GRAM_PART_BYTES = 8 << 20, 64 << 20
#: Strings that a part's task adds to its sums at once.
_SUMMED = 2_000_000


def _codes(data: np.ndarray, at: np.ndarray, order: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of texts, ends included, with the bytes before it, as one number; where each text's begin. At order 2 the triples are numbers in the order of the text; at others the bytes before the symbol stand reversed, the nearest one first."""
    n, sizes = len(at) - 1, np.diff(at)
    first = at[:-1] + (order + 1) * np.arange(n)
    out = np.empty(len(data) + (order + 1) * n, np.uint8)
    out[(np.arange(len(data)) + np.repeat((order + 1) * np.arange(n) + order, sizes))] = data
    for k in range(order):
        out[first + k] = BEGIN
    out[first + order + sizes] = END
    many = max(0, len(out) - order)
    if order == 2:
        wide = out.astype(np.uint32)
        codes = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:] if many else np.empty(0, np.uint32)
    else:
        codes = out[order:].astype(np.uint64)
        for j in range(1, order + 1):
            codes |= out[order - j : order - j + many].astype(np.uint64) << np.uint64(8 * (order + 1 - j))
    keep = np.ones(len(codes), bool)
    for k in range(1, order + 1):  # those that reach over to the next text
        keep[(first[1:] - k)] = False
    return codes[keep], at[:-1] + np.arange(n)


def _chunks(column: pa.Array, most: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, at = texts_as_bytes(column)
    yield from _pieces(data, at, most or CHUNK_BYTES)


def _pieces(data: np.ndarray, at: np.ndarray, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs lo to hi of texts of about so many bytes, with their bytes and places."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of n."""
    if not len(keys):
        return keys, n
    by = np.argsort(keys)
    keys, n = keys[by], n[by]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n, first)


def _strings(data: np.ndarray, at: np.ndarray, order: int, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of texts, sorted, with their counts in those of them that train marks."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for lo, hi, part, ends in _pieces(data, at, CHUNK_BYTES):
        codes, first = _codes(part, ends, order)
        counted = np.repeat(train[lo:hi], np.diff(np.append(first, len(codes))))
        for some, w in ((codes[counted], 1), (codes[~counted], 0)):
            if len(some):
                key, n = np.unique(some, return_counts=True)
                held.append((key, n.astype(np.int64) * w))
        if sum(len(k) for k, _ in held) > _SUMMED:
            held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
    return _summed(*map(np.concatenate, zip(*held, strict=True)))


def _part_of(keys: np.ndarray, order: int, parts: int) -> np.ndarray:
    """By the three bytes before the symbol."""
    near = (keys >> np.uint64(8 * (order - 2))) * np.uint64(0x9E3779B97F4A7C15)
    return ((near >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers of 64 bits, byte by byte of all, compressed."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(raw: bytes) -> np.ndarray:
    planes = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd")
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _find(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of wanted in sorted values, and which of them are there."""
    if not len(values):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(values, wanted)
    at[at == len(values)] = 0
    return at, values[at] == wanted


def _values(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of wanted, which are all among sorted keys and repeat a lot: each is looked up once, in order."""
    by = np.argsort(wanted)
    near = wanted[by]
    first = np.flatnonzero(np.append(True, near[1:] != near[:-1]))
    out = np.empty(len(wanted), values.dtype)
    out[by] = np.repeat(values[np.searchsorted(keys, near[first])], np.diff(np.append(first, len(near))))
    return out


def _tries(keys: np.ndarray, n: np.ndarray, order: int, least: int, below: dict[int, tuple]) -> dict[int, tuple]:
    """By order: keys of context and symbol with their counts; contexts with their totals, their numbers of symbols, and the counts that these symbols have in the context that is one byte shorter. keys are of the highest order; below has the orders under least."""
    keys, n = keys[n > 0], n[n > 0]
    out = dict(below)
    for o in range(least, order + 1):
        near = keys >> np.uint64(8 * (order + 1 - o)) if o else np.zeros(len(keys), np.uint64)
        key, count = _summed(near << np.uint64(8) | keys & np.uint64(255), n)
        context, first = np.unique(key >> np.uint64(8), return_index=True)
        total = np.add.reduceat(count, first) if len(first) else np.empty(0, np.int64)
        symbols = np.diff(np.append(first, len(key)))
        lower = np.zeros(len(context), np.int64)
        if o and len(first):
            at, _ = _find(out[o - 1][0], key >> np.uint64(16) << np.uint64(8) | key & np.uint64(255))
            lower = np.add.reduceat(out[o - 1][1][at], first)
        out[o] = key, count, context, total, symbols, lower
    return out


def _rated(keys: np.ndarray, order: int, tries: dict[int, tuple]) -> np.ndarray:
    """log10 of the probability of each key's symbol after its context."""
    out, waiting = np.zeros(len(keys)), np.arange(len(keys))
    gone, gone_symbols = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)  # counts and number of the excluded symbols
    for o in range(order, -1, -1):
        key, count, context, total, symbols, lower = tries[o]
        some = keys[waiting]
        near = some >> np.uint64(8 * (order + 1 - o)) if o else np.zeros(len(some), np.uint64)
        at, there = _find(context, near)
        place, seen = _find(key, near << np.uint64(8) | some & np.uint64(255))
        pick = lambda x: x[at] * there if len(x) else np.zeros(len(at), np.int64)  # noqa: B023, E731
        all_symbols = pick(symbols)
        rest, fresh = pick(total) - gone, all_symbols - gone_symbols
        with np.errstate(divide="ignore", invalid="ignore"):
            if len(count):
                out[waiting[seen]] += np.log10(count[place[seen]]) - np.log10((rest + fresh * (all_symbols < 256))[seen])
            out[waiting] += np.where(~seen & (fresh > 0), np.log10(fresh / (rest + fresh)), 0.0)
        gone, gone_symbols, waiting = pick(lower)[~seen], all_symbols[~seen], waiting[~seen]
    out[waiting] -= np.log10(256 - gone_symbols)
    return out.astype(np.float32)


def count_triples(texts: DataFrame, text: str = "text") -> DataFrame:
    """code and n: the byte triples of all texts with their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_LEAVES, np.int64)
        for batch in batches:
            for _, _, data, at in _chunks(batch.column(0)):
                code, n = np.unique(_codes(data, at)[0], return_counts=True)
                total[code] += n
        code = np.flatnonzero(total)
        for k in range(0, len(code), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(code[k : k + 100_000], pa.int32()), pa.array(total[code[k : k + 100_000]])], names=["code", "n"])

    return texts.select(text).mapInArrow(lean(count), "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def code_lengths(code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 of each symbol's probability after each two bytes, at (first << 16) + (second << 8) + symbol."""
    by = np.argsort(code)
    code, n = code[by], n[by]
    first = np.searchsorted(code, np.arange(257) << 16)
    c1 = np.zeros((256, 256))
    np.add.at(c1, (code >> 8 & 255, code & 255), n)
    c0 = np.bincount(code & 255, n, 256)
    out = np.empty((256, 256, 256), np.float32)
    s1, s0 = c1 > 0, c0 > 0
    # order 0, symbols of the order-1 context excluded: by context byte b
    t0 = (c0[None] * ~s1).sum(axis=1)
    q0 = (s0[None] & ~s1).sum(axis=1)
    unseen = int(256 - s0.sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        low = np.where(s0[None], np.log10(c0)[None] - np.log10(t0 + q0 * (unseen > 0))[:, None], 0.0)
        never = np.where(q0 > 0, np.log10(q0 / (t0 + q0)), 0.0) - (np.log10(unseen) if unseen else 0.0)
        low = np.where(s0[None], low, never[:, None])  # b x symbol, for symbols that b hasn't seen
        log_c1, rest = np.log10(c1), (q0 > 0) | (unseen > 0)
        for a in range(256):
            c2 = np.zeros(65536)
            c2[code[first[a] : first[a + 1]] & 65535] = n[first[a] : first[a + 1]]
            c2 = c2.reshape(256, 256)
            s2 = c2 > 0
            t2, q2 = c2.sum(axis=1), s2.sum(axis=1)
            more1 = s1 & ~s2
            t1, q1 = (c1 * more1).sum(axis=1), s1.sum(axis=1)
            fresh1 = more1.any(axis=1)
            any2 = fresh1 | rest  # is there anything to escape to
            escape2 = np.where(q2 > 0, np.log10(q2 / (t2 + q2)), 0.0)
            q1 = more1.sum(axis=1)
            one = escape2[:, None] + log_c1 - np.log10(t1 + q1 * rest)[:, None]
            escape1 = np.where(fresh1, np.log10(q1 / (t1 + q1)), 0.0)
            out[a] = np.where(s2, np.log10(c2) - np.log10(t2 + q2 * any2)[:, None], np.where(s1, one, (escape2 + escape1)[:, None] + low))
    return out.reshape(-1)


def adaptive(text: bytes, order: int = 2) -> float:
    """log10 of the text's probability, ended by END, by a trie that learns as it goes. In plain Python, for single texts."""
    tries: list[dict[bytes, dict[int, int]]] = [{} for _ in range(order + 1)]
    total, past = 0.0, bytes([BEGIN] * order)
    for symbol in (*text, END):
        excluded: set[int] = set()
        for k in range(order, -1, -1):
            seen = {s: c for s, c in tries[k].get(past[len(past) - k :], {}).items() if s not in excluded}
            if seen:
                whole = sum(seen.values()) + len(seen) * (len(excluded) + len(seen) < 256)
                if symbol in seen:
                    total += np.log10(seen[symbol] / whole)
                    break
                total += np.log10(len(seen) / whole)
                excluded |= seen.keys()
        else:
            total -= np.log10(256 - len(excluded))
        for k in range(order + 1):
            counts = tries[k].setdefault(past[len(past) - k :], {})
            counts[symbol] = counts.get(symbol, 0) + 1
        past = (past + bytes([symbol]))[1:] if order else past
    return float(total)


_tables: dict[str, np.ndarray] = {}


def _table_of(shared, key: str) -> np.ndarray:
    """The code lengths, made once in each worker for each trie, which key names."""
    if key not in _tables:
        _tables.clear()
        _tables[key] = code_lengths(*shared.value)
    return _tables[key]


def _word_counts(texts: DataFrame) -> DataFrame:
    """word (hash) and c: the words of all texts with their counts, summed before the shuffle in each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            h, c = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            word, back = np.unique(h, return_inverse=True)
            return word, np.bincount(back, c).astype(np.int64)

        def rows(word, c):
            for k in range(0, len(word), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(signed(word[k : k + 50_000])), pa.array(c[k : k + 50_000])], names=["word", "c"])

        for batch in batches:
            for w in words_of(batch.column(0), SPACED_LOWER):
                held.append(np.unique(w.hashes(), return_counts=True))
            held = [flush()] if held else []
            if held and len(held[0][0]) > 1_000_000:
                yield from rows(*held[0])
                held = []
        if held:
            yield from rows(*held[0])

    return texts.mapInArrow(lean(count), "word bigint, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds. A null id counts as the text null."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % folds


_lowest: dict[str, dict[int, tuple]] = {}


def _lowest_of(shared, key: str) -> dict[int, tuple]:
    """The tries of orders 0 to 2, made once in each worker for each trie, which key names."""
    if key not in _lowest:
        _lowest.clear()
        code, n = shared.value
        code = code.astype(np.uint64)
        turned = (code & np.uint64(0xFF00)) << np.uint64(8) | code >> np.uint64(16) << np.uint64(8) | code & np.uint64(255)
        _lowest[key] = _tries(*_summed(turned, n), 2, 0, {})
    return _lowest[key]


def _longer(scanned: DataFrame, order: int, parts: int, trie, name: str) -> DataFrame:
    """row and score, by contexts of up to order bytes: the strings of each group of texts meet their counts in parts, and their code lengths meet the texts."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of groups come sorted by part; a part's strings stay packed but for those at hand."""

        def done(part: int, blobs: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for _, data, counts in blobs:
                held.append((np.cumsum(_unpacked(data), dtype=np.uint64), _unpacked(counts).astype(np.int64)))
                if sum(len(k) for k, _ in held) > 2 * _SUMMED:
                    held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
            keys, n = _summed(*map(np.concatenate, zip(*held, strict=True)))
            held.clear()
            tries = _tries(keys, n, order, 3, _lowest_of(trie, name))
            lengths = np.concatenate([_rated(keys[k : k + _SUMMED // 4], order, tries) for k in range(0, len(keys), _SUMMED // 4)])
            for group, data, _ in blobs:
                own = lengths[np.searchsorted(keys, np.cumsum(_unpacked(data), dtype=np.uint64))]
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([part], pa.int32()), pa.array([own.astype("<f4").tobytes()], pa.binary())], names=["row", "gram_part", "data"])

        part, blobs = None, []
        for batch in batches:
            for p, group, data, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    if blobs:
                        yield from done(part, blobs)
                    part, blobs = p, []
                blobs.append((group, data, counts))
        if blobs:
            yield from done(part, blobs)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group and part: a group's texts, then its code lengths part by part."""

        def done(group: int, data: np.ndarray, at: np.ndarray, lengths: list[bytes]) -> pa.RecordBatch:
            keys, _ = _strings(data, at, order, np.ones(len(at) - 1, bool))
            rated = np.empty(len(keys), np.float32)
            rated[np.argsort(_part_of(keys, order, parts), kind="stable")] = np.frombuffer(b"".join(lengths), "<f4")
            sums = []
            for _, _, part, ends in _pieces(data, at, CHUNK_BYTES):
                codes, first = _codes(part, ends, order)
                sums.append(np.add.reduceat(_values(keys, rated, codes).astype(np.float64), first))
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(at) - 1) + group), pa.array(np.concatenate(sums))], names=["row", "score"])

        group, data, at, lengths = None, None, None, []
        for batch in batches:
            for row, part, blob, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part < 0:
                    if group is not None:
                        yield done(group, data, at, lengths)
                    group, lengths = row, []
                    size = int.from_bytes(blob[:8], "little")
                    data, at = np.frombuffer(pa.decompress(blob[8:], size, codec="zstd") if size else b"", np.uint8), _unpacked(places).astype(np.int64)
                else:
                    lengths.append(blob)
        if group is not None:
            yield done(group, data, at, lengths)

    strings = scanned.where("gram_part >= 0").select("gram_part", "row", "data", "at").repartition(parts, "gram_part").sortWithinPartitions("gram_part")
    rated = strings.mapInArrow(lean(rate), "row bigint, gram_part int, data binary").withColumn("at", F.lit(None).cast("binary"))
    texts = scanned.where("gram_part = -1").select("row", "gram_part", "data", "at")
    met = texts.unionByName(rated).repartition("row").sortWithinPartitions("row", "gram_part").mapInArrow(lean(meet), "row bigint, score double")
    return written(met, "scores")


def score(docs: DataFrame, folds: int = 7, held_out: int = 2, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs. order: bytes of the longest contexts, 2 to 7.

    Learns from rows whose fold isn't held_out. Null texts are empty: one token, the end. Repeated rows count as often as they occur. Without training rows all counts are 0 and the trie is
    empty: each byte is one of 256. Other columns of docs have no part in it, whatever their names.
    """
    if not 2 <= order <= 7:
        raise ValueError("order must be 2 to 7")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    train = rows.where(fold(F.col("doc_id"), folds) != held_out)
    triples = train.select("text").transform(count_triples)
    got = triples.toPandas()  # at most 2**24 rows
    trie = spark.sparkContext.broadcast((got["code"].to_numpy(np.int64), got["n"].to_numpy(np.int64)))
    name = uuid.uuid4().hex
    words = written(_word_counts(train.select("text")), "word-counts")
    texts = train.count()
    gram_parts = 0
    if order > 2:
        bytes_ = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        gram_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-bytes_ // GRAM_PART_BYTES))
    size = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    v, n = size[0] + (texts > 0), size[1] + texts  # the end is a token of every text
    heavy = words.where(F.col("c") * F.lit(HEAVY) > n).toPandas()  # fewer than HEAVY rows
    by_word = np.argsort(heavy["word"].to_numpy(np.int64))
    known = spark.sparkContext.broadcast((heavy["word"].to_numpy(np.int64)[by_word], heavy["c"].to_numpy(np.int64)[by_word]))
    end = float(np.log10(texts + 1))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size[0] // PART_WORDS))
    rows = row_at(rows.withColumn("__train", fold(F.col("doc_id"), folds) != held_out), "__row")

    names = ["part", "row", "tokens", "known", "base", "score", "words", "texts", "times", "doc_id", "gram_part", "data", "at"]

    def strings(group: int, data: np.ndarray, at: np.ndarray, train_: np.ndarray, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        """A group's texts (gram_part -1), and for each part its strings with their training counts."""
        raw = data.tobytes()
        keys, n = _strings(data, at, order, train_)
        part = _part_of(keys, order, gram_parts)
        by = np.argsort(part, kind="stable")
        keys, n, edges = keys[by], n[by], np.searchsorted(part[by], np.arange(gram_parts + 1))
        some = [p for p in range(gram_parts) if edges[p] < edges[p + 1]]
        cut = [slice(edges[p], edges[p + 1]) for p in some]
        blobs = [len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b""), *(_packed(np.diff(keys[c], prepend=np.uint64(0))) for c in cut)]
        counts = [_packed(at.astype(np.uint64)), *(_packed(n[c]) for c in cut)]
        none = [pa.nulls(len(blobs), kind) for kind in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), id_type)]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(blobs), pa.int32()), pa.array([group] * len(blobs), pa.int64()), *none, pa.array([-1, *some], pa.int32()), pa.array(blobs, pa.binary()), pa.array(counts, pa.binary())], names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each text (part -1) the score, the tokens and the sums over heavy words; for each part the other words, as arrays of text, word and count."""
        table, (heavy_words, heavy_counts) = _table_of(trie, name) if order == 2 else None, known.value
        logs = np.log10(heavy_counts + 1.0)
        for batch in (b.slice(k, _GROUP) for b in batches for k in range(0, len(b), _GROUP)):
            ids, docs_ = batch.column(batch.schema.get_field_index("__row")).to_numpy(), batch.column(batch.schema.get_field_index("doc_id"))
            texts = batch.column(batch.schema.get_field_index("text"))
            lengths = []
            for _, _, data, at in _chunks(texts) if order == 2 else ():
                codes, first = _codes(data, at)
                lengths += np.add.reduceat(table[codes].astype(np.float64), first).tolist()
            tokens, hits, sums, rest = [], [], [], []
            for w in words_of(texts, SPACED_LOWER):
                h, doc = signed(w.hashes()), w.doc_of_word()
                place = np.searchsorted(heavy_words, h)
                place[place == len(heavy_words)] = 0
                hit = heavy_words[place] == h if len(heavy_words) else np.zeros(len(h), bool)
                m = w.hi - w.lo
                tokens.append(w.counts)
                hits.append(np.bincount(doc[hit], minlength=m))
                sums.append(np.bincount(doc[hit], logs[place[hit]], m) if hit.any() else np.zeros(m))
                h, doc = h[~hit], doc[~hit] + w.lo
                by = np.lexsort((doc, h))
                h, doc = h[by], doc[by]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                rest.append((h[at], doc[at], np.diff(np.append(at, len(h)))))
            if not len(ids):
                continue
            if order > 2:
                train_ = batch.column(batch.schema.get_field_index("__train")).to_numpy(zero_copy_only=False)
                for lo, hi, data, at in _chunks(texts, GROUP_BYTES):
                    yield from strings(int(ids[lo]), data, at, train_[lo:hi], docs_.type)
            h, doc, times = (np.concatenate([r[i] for r in rest]) for i in range(3))
            part = (h.view(np.uint64) >> np.uint64(32)).astype(np.int64) % parts
            by = np.argsort(part, kind="stable")
            h, doc, times, edges = h[by], doc[by], times[by], np.searchsorted(part[by], np.arange(parts + 1))
            some = [p for p in range(parts) if edges[p] < edges[p + 1]]
            blob = lambda x, kind: [x[edges[p] : edges[p + 1]].astype(kind).tobytes() for p in some]
            none = [None] * len(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([-1] * len(ids) + some, pa.int32()),
                    pa.array(ids.tolist() + [int(ids[0])] * len(some), pa.int64()),
                    pa.array(np.concatenate(tokens).tolist() + [None] * len(some), pa.int64()),
                    pa.array(np.concatenate(hits).tolist() + [None] * len(some), pa.int64()),
                    pa.array(np.concatenate(sums).tolist() + [None] * len(some), pa.float64()),
                    pa.array((lengths or none) + [None] * len(some), pa.float64()),
                    pa.array(none + blob(h, "<i8"), pa.binary()),
                    pa.array(none + blob(ids[doc] - ids[0], "<i4"), pa.binary()),
                    pa.array(none + blob(times, "<i4"), pa.binary()),
                    pa.concat_arrays([docs_, pa.nulls(len(some), docs_.type)]),
                    *(pa.nulls(len(ids) + len(some), kind) for kind in (pa.int32(), pa.binary(), pa.binary())),
                ],
                names=names,
            )

    scanned = written(rows.mapInArrow(lean(scan), f"part int, row bigint, tokens bigint, known bigint, base double, score double, words binary, texts binary, times binary, doc_id {dict(rows.dtypes)['doc_id']}, gram_part int, data binary, at binary"), "scanned")
    scores = _longer(scanned, order, gram_parts, trie, name) if order > 2 else None
    counts = words.where(F.col("c") * F.lit(HEAVY) <= n).select((F.shiftright(F.col("word"), 32).bitwiseAND(F.lit(0xFFFFFFFF)) % parts).cast("int").alias("part"), "word", "c")

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of a part (as one row of arrays, first) meet the words of its texts; sums for each text."""
        own: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part, row, words_, texts_, times, counted, c in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if part not in own:
                    own.clear()
                    waiting.clear()
                    own[part] = np.empty(0, np.int64), np.empty(0, np.int64)
                if counted is not None:
                    waiting.append((np.frombuffer(counted, "<i8"), np.frombuffer(c, "<i8")))
                    continue
                if waiting:  # counts come first; they are sorted once
                    h, n_ = (np.concatenate([x[i] for x in waiting]) for i in (0, 1))
                    by = np.argsort(h)
                    own[part] = h[by], n_[by]
                    waiting.clear()
                have, n_ = own[part]
                h, doc, times = np.frombuffer(words_, "<i8"), np.frombuffer(texts_, "<i4"), np.frombuffer(times, "<i4")
                place = np.searchsorted(have, h)
                place[place == len(have)] = 0
                hit = have[place] == h if len(have) else np.zeros(len(h), bool)
                doc, place, times = doc[hit], place[hit], times[hit]
                if len(doc):
                    sums, hits = np.bincount(doc, np.log10(n_[place] + 1.0) * times), np.bincount(doc, times)
                    some = np.flatnonzero(hits)
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (some.astype("<i4"), hits[some].astype("<i8"), sums[some]))], names=["row", "texts", "known", "base"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of all parts, by text; rows come sorted by group."""
        group, known, base = None, np.zeros(_GROUP), np.zeros(_GROUP)

        def done():
            some = np.flatnonzero(known)
            return pa.RecordBatch.from_arrays([pa.array(some + group), pa.array(known[some].astype(np.int64)), pa.array(base[some])], names=["row", "known", "base"])

        for batch in batches:
            for row, *arrays in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row != group:
                    if group is not None:
                        yield done()
                    group, known, base = row, np.zeros(_GROUP), np.zeros(_GROUP)
                at, hits, sums = (np.frombuffer(x, kind) for x, kind in zip(arrays, ("<i4", "<i8", "<f8"), strict=True))
                known[at] += hits
                base[at] += sums
        if group is not None:
            yield done()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(0).to_numpy()
            by = np.argsort(part, kind="stable")
            part, h, c = part[by], batch.column(1).to_numpy()[by], batch.column(2).to_numpy()[by]
            some, at = np.unique(part, return_index=True)
            at = np.append(at, len(part))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([h[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()), pa.array([c[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["part", "counted", "c"])

    texts_side = scanned.where("part >= 0").select("part", "row", "words", "texts", "times", F.lit(None).cast("binary").alias("counted"), F.lit(None).cast("binary").alias("c"))
    counts_side = counts.mapInArrow(lean(packed), "part int, counted binary, c binary").select("part", F.lit(None).cast("bigint").alias("row"), *(F.lit(None).cast("binary").alias(x) for x in ("words", "texts", "times")), "counted", "c")
    met = texts_side.unionByName(counts_side).repartition(parts, "part").sortWithinPartitions("part", F.col("counted").isNull()).mapInArrow(lean(lookup), "row bigint, texts binary, known binary, base binary")
    met = met.repartition("row").sortWithinPartitions("row").mapInArrow(lean(added), "row bigint, known bigint, base double")
    both = scanned.where("part = -1").select("row", "doc_id", "tokens", "known", "base", "score").unionByName(met, allowMissingColumns=True)
    if scores is not None:
        both = both.unionByName(scores, allowMissingColumns=True)
    out = both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("tokens").alias("tokens"), F.sum("known").alias("known"), F.sum("base").alias("base"), F.max("score").alias("score"))
    tokens = F.col("tokens") + 1
    return out.select(
        "doc_id",
        (fold(F.col("doc_id"), folds) == held_out).alias("held_out"),
        tokens.alias("n_tokens"),
        (F.col("known") + F.lit(int(texts > 0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.lit(end) - tokens * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        "score",
    )
