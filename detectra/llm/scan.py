"""Vectorised text scanning on whole Arrow batches: word bounds, fingerprints, winnowing.

Everything works on the UTF-8 bytes of many documents at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that one vectorised pass works on; a longer document is a pass of its own.
PASS_BYTES = 1 << 20


def lower_table() -> np.ndarray:
    """Byte table that lower-cases A-Z only."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_table()
#: Bytes that separate words: space and \\t \\n \\v \\f \\r.
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
#: Bytes that separate words of letters and digits, after lower-casing; all non-ASCII bytes are word bytes.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: a bijection that spreads every input bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


@lru_cache(maxsize=32)
def _family(seed: int) -> tuple[np.uint64, np.uint64, np.ndarray]:
    """Two random numbers and an odd multiplier for each level of doubling."""
    r = np.random.default_rng(seed)
    a, b = r.integers(1, 2**64 - 1, 2, dtype=np.uint64)
    return a, b, r.integers(0, 2**63, 48, dtype=np.uint64) * U(2) + U(1)


#: Ranges of more bytes are read on their own, all their loads at once.
LONG = 1 << 10
#: Byte grams are made for so many positions at a time, which a core's cache holds.
SLICE = 1 << 14
#: Of a load of eight bytes, the first 0 to 8.
MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one number; zeros follow the last byte."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


class Prints:
    """Fingerprints of any range of symbols: bytes, or 64-bit values of words.

    Neither is linear in its symbols, so strings that a polynomial sum confuses are told apart.
    Ranges of bytes are read eight at a time through a bijective mixer.  Ranges of words, and byte
    grams of one length, come by doubling: a block of 2n symbols mixes two blocks of n, and a range
    is its first and its last block, which together cover it.
    """

    def __init__(self, symbols: np.ndarray, seed: int = 1):
        self.seed = seed
        self.first, self.last, self.odd = _family(seed)
        self.bytes = symbols.dtype == np.uint8
        self.n = len(symbols)
        self.base = loads(symbols) if self.bytes else mix(symbols ^ self.first)

    def at(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Fingerprints of the ranges [s, e)."""
        return self._read(s, e) if self.bytes else self._blocks(s, e)

    def _read(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        n = e - s
        out = mix(n.astype(np.uint64) * self.odd[0] + self.first)
        live = np.flatnonzero((n > 0) & (n <= LONG))
        at, left = s[live], n[live]
        while len(live):
            h = mix(out[live] ^ (self.base[at] & MASKS[np.minimum(left, 8)])) * self.odd[1]
            out[live] = h ^ (h >> U(29))
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        for i in np.flatnonzero(n > LONG).tolist():
            x = self.base[s[i] : e[i] : 8].copy()
            x[-1] &= MASKS[(n[i] - 1) % 8 + 1]
            out[i] ^= Prints(x, self.seed)._blocks(np.zeros(1, np.int64), np.full(1, len(x)))[0]
        return mix(out ^ self.last)

    def _double(self, blocks: np.ndarray, level: int) -> np.ndarray:
        """From blocks of 2 ** level symbols those of twice as many."""
        x = blocks[: -(1 << level)] * self.odd[level]
        x += blocks[1 << level :]
        x ^= x >> U(32)
        return x

    def _blocks(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        n = e - s
        out = np.full(len(s), self.last)
        blocks, level, todo = self.base, 0, int((n > 0).sum())
        while todo:
            own = np.flatnonzero((n >> level) == 1)
            if len(own):
                x = blocks[s[own]] * self.odd[40] + blocks[e[own] - (1 << level)]
                out[own] = x ^ (x >> U(31))
                todo -= len(own)
            if todo:
                blocks = self._double(blocks, level)
                level += 1
        return mix(out * self.odd[41] + n.astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Fingerprints of all k-grams, by start; meaningless where a gram would cross documents."""
        count = self.n - k + 1
        if count <= 0:
            return np.zeros(0, np.uint64)
        if not self.bytes:
            at = np.arange(count)
            return self._blocks(at, at + k)
        if k <= 8:
            return mix((self.base[:count] & MASKS[k]) ^ self.first)
        out = np.empty(count, np.uint64)
        for i in range(0, count, SLICE):
            j = min(count, i + SLICE)
            blocks, level = mix(self.base[i : j + k - 8] ^ self.first), 3
            while 2 << level <= k:
                blocks = self._double(blocks, level)
                level += 1
            x = blocks[: j - i] * self.odd[40]
            x += blocks[k - (1 << level) : k - (1 << level) + j - i]
            out[i:j] = mix(x)
        return out


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, and n + 1 offsets into them; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    _, off, data = col.buffers()
    if len(col) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def passes(data: np.ndarray, offsets: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, after last, bytes, offsets) of runs of whole documents of about ``limit`` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and n + 1 word offsets by document; no word crosses documents."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = inside[offsets[1:][offsets[:-1] < offsets[1:]] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def window_starts(offsets: np.ndarray, length: int) -> np.ndarray:
    """Starts of all windows of ``length`` symbols inside one document."""
    n = np.maximum(np.diff(offsets) - length + 1, 0)
    total = int(n.sum())
    return np.arange(total) + np.repeat(offsets[:-1] - (np.cumsum(n) - n), n)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, in three passes whatever w is."""
    n = len(x)
    if n < w:
        return np.zeros(0, x.dtype)
    blocks = -(-n // w)
    y = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    y[:n] = x
    y = y.reshape(blocks, w)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors(grams: np.ndarray, w: int) -> np.ndarray:
    """For every run of w neighbouring grams, the position of its smallest; of ties, the last."""
    at = U(0xFFFFFFFF) - np.arange(len(grams), dtype=np.uint64)
    key = (grams & U(0xFFFFFFFF00000000)) | at
    return (U(0xFFFFFFFF) - (sliding_min(key, w) & U(0xFFFFFFFF))).astype(np.int64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + length), one after another."""
    total = int(lengths.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def covered(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Which of n positions lie in a range."""
    if not len(starts):
        return np.zeros(n, bool)
    d = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(d[:n]) > 0
