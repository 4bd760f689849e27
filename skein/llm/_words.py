"""Words of Arrow text columns as numpy arrays: spans, hashes and window hashes, a chunk of texts at a time.

All word patterns of this subpackage split at ASCII bytes only, so that words can be cut from UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from skein.llm._shared import AT_END

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BASES = {"byte": _BASE, "word": 0xD6E8FEB86659FD93}


@dataclass(frozen=True)
class Kind:
    """Which bytes belong to words, and what each byte counts as."""

    name: str
    keep: np.ndarray
    fold: np.ndarray

    @property
    def translate(self) -> bytes:
        """For bytes.translate(): folded word bytes, and a space for any other."""
        return np.where(self.keep, self.fold, 32).astype(np.uint8).tobytes()


def _kind(name: str, keep: list[bool], lower: bool) -> Kind:
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[65:91] += 32
    return Kind(name, np.array(keep), fold)


#: After lower-casing A-Z: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = _kind("alnum", [48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)], True)
#: [^\x20\x09-\x0D]+
SPACED = _kind("spaced", [not (b == 32 or 9 <= b <= 13) for b in range(256)], False)
#: The same after lower-casing A-Z.
SPACED_LOWER = _kind("spaced_lower", [not (b == 32 or 9 <= b <= 13) for b in range(256)], True)

_LETTERS = np.random.Generator(np.random.PCG64(20_011)).integers(0, 2**64, 256, dtype=np.uint64)
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}
AT_END.append(_powers.clear)


def _power_tables(which: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 65_536)
        tables = []
        for base in (_BASES[which], pow(_BASES[which], -1, 2**64)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            tables.append(np.cumprod(table, dtype=np.uint64))
        have = tables[0], tables[1]
        if n <= CHUNK_BYTES + 65_536:
            _powers[which] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (splitmix64's last steps)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def texts_as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the len + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), at


@dataclass
class Words:
    """The words of texts lo to hi of a batch. bounds[i]:bounds[i + 1] are the words of text lo + i."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    kind: Kind

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, folded."""
        if not len(self):
            return np.empty(0, np.uint64)
        n = len(self.data)
        up, down = _power_tables("byte", n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTERS[self.kind.fold][self.data] * up[:n], out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64) * np.uint64(_BASE))

    def window_hashes(self, h: np.ndarray, k: int) -> np.ndarray:
        """For each word the hash of the k words from it on; what passes the end of a text has no meaning (see inside)."""
        n = len(h)
        if n < k:
            return np.zeros(n, np.uint64)
        up, down = _power_tables("word", n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * up[:n], out=sums[1:])
        out = np.zeros(n, np.uint64)
        out[: n - k + 1] = mix((sums[k:] - sums[: n - k + 1]) * down[: n - k + 1] + np.uint64(k))
        return out

    def range_hashes(self, h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A hash of the words from first to last (not included), for arrays of both."""
        n = len(h)
        up, down = _power_tables("word", n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * up[:n], out=sums[1:])
        return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))

    def inside(self, k: int) -> np.ndarray:
        """Whether the k words from each word on belong to one text."""
        last = np.repeat(self.bounds[1:], self.counts)
        return np.arange(len(self)) + k <= last

    def joined(self, i: int, j: int) -> bytes:
        """Words i to j (not included), folded, joined by one space."""
        if j <= i:
            return b""
        raw = self.data[self.starts[i] : self.ends[j - 1]].tobytes()
        return b" ".join((raw if self.kind is SPACED else raw.translate(self.kind.translate)).split())  # split() knows the white bytes of SPACED


def words_of(column: pa.Array, kind: Kind, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Words]:
    """The words of a text column, in chunks of whole texts of about chunk_bytes; a longer text is a chunk of its own."""
    data, at = texts_as_bytes(column)
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + chunk_bytes, "right")) - 1)
        part, offsets = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        keep = kind.keep[part]
        before, after = np.zeros(len(part), bool), np.zeros(len(part), bool)
        before[1:], after[:-1] = keep[:-1], keep[1:]
        full = offsets[:-1] < offsets[1:]
        before[offsets[:-1][full]] = False
        after[offsets[1:][full] - 1] = False
        starts = np.flatnonzero(keep & ~before)
        ends = np.flatnonzero(keep & ~after) + 1
        yield Words(lo, hi, part, offsets, starts, ends, np.searchsorted(starts, offsets), kind)
        lo = hi


def signed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return h.view(np.int64)
