"""Byte-level BPE encoding and decoding by DuckDB recursive queries within Spark's tasks.

Each task cuts its texts with the tokenizer's pattern and keeps the distinct pieces that its worker hasn't met yet. Their bytes become lists of tokens;
a recursive query contracts each piece's leftmost pair of least rank, joins the two pairs that this makes to the merge table, and ends at the fixpoint. A piece that is a token itself is that token, as in the
tiktoken library. Pieces don't depend on what stands around them, so that a worker looks up those it knows; its table holds PIECE_BYTES of what was used last. Decoding takes each document's own
ids: rows of document, position and id join the vocabulary, and an ordered aggregation gives their bytes.

Where `spaced` holds for a pattern, texts are cut before spaces first, and each distinct part of a chunk is cut by the pattern once, many of them as one text. It holds if no piece reaches over the place before a space, but may begin there, wherever the character
before this place or the one behind the space isn't white: so for public_tokenizers.PATTERN. Texts with other spaces, and all texts of a pattern for which it doesn't hold, are cut by the pattern alone.

Pieces of more than LONG bytes are cut into spans of SPAN bytes that are encoded each for itself and then joined two by two: the last WINDOW tokens of the one and the first WINDOW of the other are encoded anew
as one string. If that string's first and last tokens are the old ones, the joined tokens are what the whole would have given; if not, the window is widened. This is exact: tokens are the encoding of their bytes if, and only if, any two
neighbours are the encoding of theirs. (The first contraction that reached over a token's end would come up in the encoding of the two tokens there, too.) So time grows with the length, not its square. Windows that
become longer than LONG bytes, such as runs of one character, go through a second query, a few rounds at a time: all non-overlapping places of the least pair are contracted at once where the merged token can't
start a pair of lower rank (`calm`); elsewhere only the leftmost is.
"""

from __future__ import annotations

import base64
import sys
import threading
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm._shared import lean, trim
from skein.llm._words import texts_as_bytes

LONG, SPAN, WINDOW = 48, 32, 4
#: Bytes that a worker's table of pieces may take, keys, values and what Python adds; bytes of parts that the pattern cuts as one text.
PIECE_BYTES, PART_BYTES = 64 << 20, 1 << 20
#: Seconds after which a worker that does something else drops its tables.
IDLE = 20
#: Bytes of text that are encoded at once, and ids that are decoded at once; longer texts go through in parts.
CHUNK_BYTES, DECODED_IDS = 3 << 20, 200_000
#: Bytes of long pieces, and so rows to begin with, of a query; of others.
QUERY_BYTES, SHORT_BYTES = 100_000, 300_000
_ROUNDS = 16
_ENTRY = 200  # what Python adds to a table's entry

_NONE = 2**31 - 1  # the rank of a pair that isn't merged

#: A row for each piece (w) with its tokens and the rank of each pair of neighbours; least is the smallest one.
_ENCODE = f"""
WITH RECURSIVE s AS (
  SELECT w, toks, ranks, coalesce(list_min(ranks), {_NONE}) AS least FROM start_lists
  UNION ALL
  SELECT w, toks, ranks, coalesce(list_min(ranks), {_NONE})
  FROM (
    SELECT w, list_concat(toks[:place - 1], [least], toks[place + 2:]) AS toks, list_concat(
      ranks[1:greatest(place - 2, 0)], CASE WHEN place > 1 THEN [coalesce(a.new, {_NONE})] ELSE [] END, CASE WHEN place < len(ranks) THEN [coalesce(b.new, {_NONE})] ELSE [] END, ranks[place + 2:]
    ) AS ranks
    FROM (
      SELECT *, (CAST(toks[place - 1] AS BIGINT) << 32) + least AS before, (CAST(least AS BIGINT) << 32) + toks[place + 2] AS behind
      FROM (SELECT *, list_position(ranks, least) AS place FROM s WHERE least < {_NONE})
    ) p LEFT JOIN merges a ON a.pair = p.before LEFT JOIN merges b ON b.pair = p.behind
  )
)
SELECT w, toks FROM s WHERE least = {_NONE}
"""

#: Rows of a piece (w) with the byte place (pos) of each token; best packs the rank of the least pair and its place.
_ENCODE_LONG = f"""
WITH RECURSIVE s AS (
  SELECT 0 AS it, w, pos, tok, false AS done FROM start_rows
  UNION ALL
  SELECT it + 1, w, pos, CASE WHEN go THEN CAST(best >> 32 AS INTEGER) ELSE tok END, false
  FROM (
    SELECT *, coalesce(lag(go) OVER (PARTITION BY w ORDER BY pos), false) AS gone
    FROM (
      SELECT *, may AND (place - coalesce(max(CASE WHEN NOT may THEN place END) OVER (PARTITION BY w ORDER BY pos), 0)) % 2 = 1 AS go
      FROM (
        SELECT q.*, new IS NOT NULL AND new = best >> 32 AND (c.id IS NOT NULL OR pos = best & 4294967295) AS may
        FROM (
          SELECT p.*, m.new, min((CAST(m.new AS BIGINT) << 32) + p.pos) OVER (PARTITION BY p.w) AS best
          FROM (SELECT it, w, pos, tok, lead(tok) OVER o AS nxt, row_number() OVER o AS place FROM s WINDOW o AS (PARTITION BY w ORDER BY pos)) p
          LEFT JOIN merges m ON m.pair = (CAST(p.tok AS BIGINT) << 32) + p.nxt
        ) q LEFT JOIN calm c ON c.id = q.best >> 32
        WHERE best IS NOT NULL
      )
    )
  ) WHERE NOT gone AND it < {_ROUNDS}
)
SELECT w, pos, tok FROM s QUALIFY it = max(it) OVER (PARTITION BY w)
"""

_DECODE = """
SELECT r.w, list(v.bytes ORDER BY r.pos) AS parts FROM token_rows r JOIN vocabulary v ON v.id = r.tok GROUP BY r.w ORDER BY r.w
"""


class _Recent:
    """A table of what was used last, of about so many bytes at most: two generations, the older of which is dropped when the newer has half of them."""

    def __init__(self, most: int):
        self.most, self.size = most, 0
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def put(self, keys: list[str], values: list[bytes]) -> None:
        for k in range(0, len(keys), 1000):
            if self.size > self.most // 2:
                self.old, self.new, self.size = self.new, {}, 0
            some, of_some = keys[k : k + 1000], values[k : k + 1000]
            self.new.update(zip(some, of_some, strict=True))
            self.size += sum(map(len, some)) + sum(map(len, of_some)) + _ENTRY * len(some)

    def get(self, keys: list[str]) -> list[bytes | None]:
        """The values of distinct keys, None for those it doesn't have."""
        out = list(map(self.new.get, keys))
        if self.old:
            again = [i for i, v in enumerate(out) if v is None and keys[i] in self.old]
            for i in again:
                out[i] = self.old[keys[i]]
            self.put([keys[i] for i in again], [out[i] for i in again])
        return out


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i] to starts[i] + lengths[i], one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class Codec:
    """A rank file and a pattern, in one worker."""

    def __init__(self, ranks_path: str, pattern: str, spaced: bool):
        import duckdb
        import regex

        with open(ranks_path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.pattern = regex.compile(pattern)
        self.of_byte = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.of_byte < 0).any():
            raise ValueError("the rank file lacks some single bytes")
        pair, new, restless = [], [], set()
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pair.append((a << 32) + b)
                    new.append(rank)
                    restless.update(x for x in (a, b) if x > rank)
        # what a query holds is bounded by the chunks, so that it needs no folder to spill to
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        self.of_two = np.full(1 << 16, _NONE, np.int32)  # the rank of two bytes
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.of_two[int.from_bytes(token, "big")] = rank
        self._table("merges", pair=np.array(pair, np.int64), new=np.array(new, np.int32))
        self._table("vocabulary", id=np.array(list(self.ranks.values()), np.int32), bytes=pa.array(list(self.ranks), pa.binary()))
        self._table("calm", id=np.array([r for r in self.ranks.values() if r not in restless], np.int32))
        self.sizes = np.zeros(max(self.ranks.values()) + 1, np.int32)  # of each id, in bytes
        for token, rank in self.ranks.items():
            self.sizes[rank] = len(token)
        self.spaced = spaced
        self.pieces = _Recent(PIECE_BYTES)

    def _table(self, name: str, **columns) -> None:
        self.db.register("given", pa.table({k: pa.array(v) for k, v in columns.items()}))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _ask(self, query: str, name: str, **columns) -> pa.Table:
        self.db.register(name, pa.table(columns))
        try:
            return self.db.sql(query).to_arrow_table()
        finally:
            self.db.unregister(name)

    def _merged(self, strings: list[bytes]) -> list[np.ndarray]:
        """The ids that merges give for each string, which isn't empty."""
        return [np.frombuffer(x, np.int32) for x in self._merged_bytes(strings)]

    def _merged_bytes(self, strings: list[bytes]) -> list[bytes]:
        """The same as int32 bytes."""
        out = [b""] * len(strings)
        for long in (False, True):
            todo, most = [i for i, p in enumerate(strings) if (len(p) > LONG) == long], QUERY_BYTES if long else SHORT_BYTES
            ends, lo = np.cumsum([len(strings[i]) for i in todo]), 0
            while lo < len(todo):
                hi = max(lo + 1, int(np.searchsorted(ends, most + (int(ends[lo - 1]) if lo else 0), "right")))
                some, lo = todo[lo:hi], hi
                got, sizes = (self._long if long else self._short)([strings[i] for i in some])
                data, at = got.tobytes(), 0
                for i, end in zip(some, (4 * np.cumsum(sizes)).tolist(), strict=True):
                    out[i] = data[at:end]
                    at = end
        return out

    def _short(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and each one's number of them."""
        bounds = np.append(0, np.cumsum([len(p) for p in pieces]))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        two = np.delete(self.of_two[(raw[:-1].astype(np.int32) << 8) + raw[1:]], bounds[1:-1] - 1)  # not from a piece to the next
        lists, ranks = (pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(of)) for at, of in ((bounds, self.of_byte[raw]), (bounds - np.arange(len(bounds)), two)))
        got = self._ask(_ENCODE, "start_lists", w=np.arange(len(pieces), dtype=np.int32), toks=lists, ranks=ranks).combine_chunks()
        by = np.argsort(got["w"].to_numpy())
        toks = got["toks"].take(pa.array(by)).combine_chunks()
        return toks.flatten().to_numpy().astype(np.int32, copy=False), toks.value_lengths().to_numpy()

    def _long(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same, some rounds at a time."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        tok = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        pos = (np.arange(len(tok)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        w = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        before = len(tok) + 1
        while len(tok) < before:
            before = len(tok)
            got = self._ask(_ENCODE_LONG, "start_rows", w=w, pos=pos, tok=tok)
            w, pos, tok = (got[c].to_numpy() for c in ("w", "pos", "tok"))
            order = np.argsort((w.astype(np.int64) << 32) + pos)
            w, pos, tok = w[order], pos[order], tok[order]
        return tok.astype(np.int32, copy=False), np.bincount(w, minlength=len(pieces))

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        return [np.frombuffer(x, np.int32) for x in self._encoded(pieces)]

    def _encoded(self, pieces: list[bytes]) -> list[bytes]:
        """The same as int32 bytes."""
        ranks = map(self.ranks.get, pieces)
        out = [b"" if r is None else r.to_bytes(4, sys.byteorder) for r in ranks]
        todo = [i for i, p in enumerate(pieces) if p and not out[i]]
        short = [i for i in todo if len(pieces[i]) <= LONG]
        for i, ids in zip(short, self._merged_bytes([pieces[i] for i in short]), strict=True):
            out[i] = ids
        long = [i for i in todo if len(pieces[i]) > LONG]
        for k in range(0, len(long), 1000):
            for i, ids in zip(long[k : k + 1000], self._joined([pieces[i] for i in long[k : k + 1000]]), strict=True):
                out[i] = ids.tobytes()
        return out

    def _joined(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of long pieces, from those of their spans."""
        cut = [[p[k : k + SPAN] for k in range(0, len(p), SPAN)] for p in pieces]
        flat = iter(self._merged([x for c in cut for x in c]))
        spans = [[(x, next(flat)) for x in c] for c in cut]
        while any(len(s) > 1 for s in spans):
            pairs = [(i, k) for i, s in enumerate(spans) for k in range(0, len(s) - 1, 2)]
            done: dict[tuple[int, int], np.ndarray] = {}
            width = WINDOW
            while len(done) < len(pairs):
                tried = []
                for i, k in pairs:
                    if (i, k) not in done:
                        (raw, a), (more, b) = spans[i][k], spans[i][k + 1]
                        x, y = min(width, len(a)), min(width, len(b))
                        tried.append((i, k, a, b, x, y, raw[len(raw) - int(self.sizes[a[len(a) - x :]].sum()) :] + more[: int(self.sizes[b[:y]].sum())]))
                for (i, k, a, b, x, y, _), ids in zip(tried, self._merged([t[-1] for t in tried]), strict=True):
                    if (x == len(a) or ids[0] == a[len(a) - x]) and (y == len(b) or ids[-1] == b[y - 1]):
                        done[i, k] = np.concatenate([a[: len(a) - x], ids, b[y:]])
                width *= 4
            spans = [[(s[k][0] + s[k + 1][0], done[i, k]) if k + 1 < len(s) else s[k] for k in range(0, len(s), 2)] for i, s in enumerate(spans)]
        return [s[0][1] for s in spans]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> Iterator[bytes]:
        """The bytes of each of the lists ids[bounds[i]:bounds[i + 1]]."""
        lengths = np.diff(bounds)
        lo = 0
        while lo < len(lengths):
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + DECODED_IDS, "right")) - 1)
            out = [b""] * (hi - lo)
            for a in range(int(bounds[lo]), int(bounds[hi]), DECODED_IDS):  # more than once for a long list only, whose parts follow each other
                b = min(a + DECODED_IDS, int(bounds[hi]))
                w = np.repeat(np.arange(hi - lo, dtype=np.int32), lengths[lo:hi])[a - int(bounds[lo]) : b - int(bounds[lo])]
                got = self._ask(_DECODE, "token_rows", w=w, pos=np.arange(b - a, dtype=np.int32), tok=ids[a:b])
                for part in got.to_batches():
                    lists = part.column(1)
                    tokens = lists.flatten()
                    ends = np.cumsum(lists.value_lengths().to_numpy())
                    _, at, data = tokens.buffers()
                    at = np.frombuffer(at, np.int32)[tokens.offset : tokens.offset + len(tokens) + 1]
                    view, first = memoryview(data), 0
                    for doc, end in zip(part.column(0).to_pylist(), ends.tolist(), strict=True):
                        out[doc] += bytes(view[at[first] : at[end]])
                        first = end
            yield from out
            lo = hi

    def _of_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids, as int32 bytes, of distinct pieces."""
        out = self.pieces.get(pieces)
        new = [i for i, v in enumerate(out) if v is None]
        for k in range(0, len(new), 50_000):
            some = new[k : k + 50_000]
            found = self._encoded([pieces[i].encode() for i in some])
            for i, ids in zip(some, found, strict=True):
                out[i] = ids
            self.pieces.put([pieces[i] for i in some], found)
        return out

    def _cut(self, parts: pa.Array, alone: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all parts, one after the other, and each part's number of them. Parts that aren't alone begin with a space behind which, and end where, there is nothing white, so that they are cut as one text."""
        data, at = texts_as_bytes(parts)
        pieces, waiting, counts = [], [], np.zeros(len(parts), np.int64)
        # runs of parts of one kind, of about PART_BYTES
        run = np.cumsum(np.append(False, alone[1:] | alone[:-1])) if len(parts) else np.empty(0, np.int64)
        run = run * (1 << 32) + at[1:] // PART_BYTES
        edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(parts)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            found = self.pattern.findall(data[at[lo] : at[hi]].tobytes().decode())
            if hi - lo == 1:
                counts[lo] = len(found)
                waiting += found
            elif hi > lo:
                pieces += [pa.array(waiting, pa.string()), pa.array(found, pa.string())]
                waiting = []
                ends, due = texts_as_bytes(pieces[-1])[1], at[lo + 1 : hi + 1] - at[lo]
                upto = np.searchsorted(ends[1:], due, "right")
                if upto[-1] != len(found) or not np.array_equal(ends[upto], due):  # the pattern leaves something out
                    each = [self.pattern.findall(t) for t in parts[lo:hi].to_pylist()]
                    pieces[-1], upto = pa.array([p for e in each for p in e], pa.string()), np.cumsum([len(e) for e in each])
                counts[lo:hi] = np.diff(upto, prepend=0)
        return pa.concat_arrays([*pieces, pa.array(waiting, pa.string())]), counts

    def _of_parts(self, parts: pa.Array, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct parts of texts that were cut before spaces, one after the other, and each part's number of them."""
        pieces, counts = self._cut(parts, alone)
        coded = pieces.dictionary_encode()
        del pieces
        trim()
        data, at = texts_as_bytes(pa.array(self._of_pieces(coded.dictionary.to_pylist()), pa.binary()))
        trim()
        lengths = np.diff(at) // 4
        which = coded.indices.to_numpy()
        of_piece = lengths[which]
        ids = data[: at[-1]].view(np.int32)[_ragged(at[:-1][which] // 4, of_piece)]
        sums = np.append(0, np.cumsum(of_piece))
        ends = np.cumsum(counts)
        return ids, sums[ends] - sums[ends - counts]

    def _by_pattern(self, text: str) -> np.ndarray:
        """The ids of a text that isn't cut before."""
        out, waiting = [], []

        def flush():
            pieces = list(set(waiting))
            known = dict(zip(pieces, self._of_pieces(pieces), strict=True))
            out.append(b"".join(map(known.__getitem__, waiting)))
            waiting.clear()

        for found in self.pattern.finditer(text):
            waiting.append(found[0])
            if len(waiting) == 200_000:
                flush()
        flush()
        return np.frombuffer(b"".join(out), np.int32)

    def _by_spaces(self, texts: pa.Array) -> list[np.ndarray | None]:
        """The ids of each text; None for those with spaces at which it can't be cut."""
        lists = pc.split_pattern(texts, " ")
        flat = lists.flatten()
        coded = flat.dictionary_encode()
        parts, which = coded.dictionary, coded.indices.to_numpy()
        ends = np.cumsum(lists.value_lengths().to_numpy())
        starts = ends - lists.value_lengths().to_numpy()
        filled = pc.greater(pc.binary_length(parts), 0)
        solid_start, solid_of_part = (pc.and_not(filled, pc.utf8_is_space(pc.utf8_slice_codeunits(parts, *ends_at))).to_numpy(zero_copy_only=False) for ends_at in ((0, 1), (-1,)))
        can, solid_end = solid_start[which], solid_of_part[which]
        can[1:] |= solid_end[:-1]
        can[starts] = True
        sound = np.logical_and.reduceat(can, starts)
        first = np.zeros(len(which), bool)
        first[starts] = True
        # the part behind a space has that space; a text's first part has none
        used = np.repeat(sound, ends - starts)
        key = (which * 2 + first)[used]
        asked = np.zeros(2 * len(parts), bool)
        asked[key] = True
        distinct = np.flatnonzero(asked)
        place = (np.cumsum(asked) - 1)[key]
        behind, heads = pc.take(parts, pa.array(distinct >> 1)), distinct % 2 == 1
        all_ids, lengths = self._of_parts(pc.if_else(pa.array(heads), behind, pc.binary_join_element_wise("", behind, " ")), heads | ~(solid_start & solid_of_part)[distinct >> 1])
        of_part = lengths[place]
        out = all_ids[_ragged((np.cumsum(lengths) - lengths)[place], of_part)]
        sums = np.zeros(len(which), np.int64)
        sums[used] = of_part
        each = iter(np.split(out, np.cumsum(np.add.reduceat(sums, starts)[sound])[:-1])) if sound.any() else iter(())
        return [next(each) if s else None for s in sound.tolist()]

    def _pieces_of_long(self, text: str) -> list[str]:
        """A text of many bytes, cut before spaces that have no white neighbour."""
        out, at, step = [], 0, CHUNK_BYTES // 4
        while len(text) - at > step:
            cut = at + step
            while (cut := text.find(" ", cut)) >= 0 and (text[cut - 1].isspace() or cut + 1 == len(text) or text[cut + 1].isspace()):
                cut += 1
            if cut < 0:
                break
            out.append(text[at:cut])
            at = cut
        return [*out, text[at:]]

    def ids(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of texts, null as empty, their ids and the places in them where each text's begin, and the last one's end."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.append(0, np.cumsum(sizes))
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(before, before[lo] + CHUNK_BYTES, "right")) - 1)
            some = texts.slice(lo, hi - lo).fill_null("")
            if not self.spaced:
                found = [self._by_pattern(t) for t in some.to_pylist()]
            elif before[hi] - before[lo] > CHUNK_BYTES:
                parts = [self._by_spaces(pa.array([p]))[0] for p in self._pieces_of_long(some[0].as_py())]
                found = [np.concatenate(parts) if all(p is not None for p in parts) else self._by_pattern(some[0].as_py())]
            else:
                found = [self._by_pattern(some[i].as_py()) if x is None else x for i, x in enumerate(self._by_spaces(some))]
            found, bounds = np.concatenate(found), np.append(0, np.cumsum([len(x) for x in found]))
            trim()
            yield found, bounds
            lo = hi


_codecs: dict[tuple[str, str, bool], Codec] = {}
_used: dict[tuple[str, str, bool], float] = {}
_lock = threading.Lock()
_watching: list[threading.Thread] = []


def _drop_idle() -> None:
    """Forgets codecs that no task has asked for in a while; a task that still holds one goes on with it."""
    while True:
        time.sleep(IDLE / 4)
        with _lock:
            for key in [k for k, at in _used.items() if time.monotonic() - at > IDLE]:
                _codecs.pop(key, None)
                _used.pop(key, None)


def codec(ranks_path: str, pattern: str, spaced: bool) -> Codec:
    """One for each worker."""
    key = ranks_path, pattern, spaced
    with _lock:
        if not any(t.is_alive() for t in _watching):
            _watching[:] = [threading.Thread(target=_drop_idle, daemon=True)]
            _watching[0].start()
        if key not in _codecs:
            _codecs[key] = Codec(*key)
        _used[key] = time.monotonic()
        return _codecs[key]


def _mapped(df: DataFrame, column: str, setting: tuple[str, str, bool], added: list[tuple[str, pa.DataType, T.DataType]], values) -> DataFrame:
    """df with columns added; values(codec, slice of the column) gives arrays of them, for runs of its rows."""
    names = [n for n, _, _ in added]
    df = df.drop(*names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, at = codec(*setting), 0
            for new in values(own, batch.column(batch.schema.get_field_index(column))):
                n = len(new[0])
                yield pa.RecordBatch.from_arrays([*batch.slice(at, n).columns, *(pa.array(v, t) for v, (_, t, _) in zip(new, added, strict=True))], names=[*batch.schema.names, *names])
                at += n
                codec(*setting)  # still in use

    return df.mapInArrow(lean(work), T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, _, t in added)]))


def _lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", spaced: bool = True) -> DataFrame:
    """df with token_ids (array<int>). Null texts are empty and have no ids; a column token_ids of df is replaced. spaced: see above; false is right for any pattern, and slower."""

    def ids(own: Codec, texts: pa.Array):
        for got in own.ids(texts):
            yield [_lists(*got)]

    return _mapped(df, text, (ranks_path, pattern, spaced), [("token_ids", pa.list_(pa.int32()), T.ArrayType(T.IntegerType()))], ids)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "token_ids") -> DataFrame:
    """df with decoded (binary), the bytes that the ids stand for; a column decoded of df is replaced. Null is no ids. An id that isn't in the rank file, or null, is an error."""

    def back(own: Codec, lists: pa.Array):
        known = np.zeros(len(own.sizes), bool)
        known[list(own.ranks.values())] = True
        for k in range(0, len(lists), 500):
            some = lists.slice(k, 500)
            if some.flatten().null_count:
                raise ValueError("an id is null")
            given = some.flatten().to_numpy()
            if len(given) and (given.min() < 0 or given.max() >= len(known) or not known[given].all()):
                raise ValueError("an id isn't in the rank file")
            yield [list(own.decode(given, np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(some), 0).to_numpy(zero_copy_only=False)))))]

    return _mapped(df, ids, (ranks_path, pattern, True), [("decoded", pa.binary(), T.BinaryType())], back)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", spaced: bool = True) -> DataFrame:
    """df with token_ids (array<int>), n_tokens and decoded, the text that the ids decode to. Null texts are empty; columns of df with these names are replaced."""

    def both(own: Codec, texts: pa.Array):
        for ids, bounds in own.ids(texts):
            yield [_lists(ids, bounds), np.diff(bounds), [raw.decode() for raw in own.decode(ids, bounds)]]

    added = [("token_ids", pa.list_(pa.int32()), T.ArrayType(T.IntegerType())), ("n_tokens", pa.int64(), T.LongType()), ("decoded", pa.string(), T.StringType())]
    return _mapped(df, text, (ranks_path, pattern, spaced), added, both)


def digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row per document: n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded bytes)."""

    def digests(own: Codec, texts: pa.Array):
        for ids, bounds in own.ids(texts):
            names = pa.array(ids).cast(pa.string())
            written = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), names), ",")
            yield [np.diff(bounds), written, list(own.decode(ids, bounds))]

    added = [("n_tokens", pa.int64(), T.LongType()), ("ids", pa.string(), T.StringType()), ("decoded", pa.binary(), T.BinaryType())]
    out = _mapped(docs.select("doc_id", "text"), "text", (ranks_path, pattern, True), added, digests)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
