"""Vectorised kernels over whole Arrow batches of UTF-8 text.

Texts stay in the single byte buffer that Arrow delivers; words are found,
hashed and grouped with array operations over that buffer, so no Python loop
runs per character or per word.  A word is a maximal run of bytes other than
space and tab..carriage return (``[^\\x20\\x09-\\x0D]+``); null texts are empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_P = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64 = _P) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; row i is bytes[offsets[i]:offsets[i+1]]."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


class Words:
    """Word spans of a batch: starts, ends (bytes), and first[i]:first[i+1] are row i's words."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        solid = ~_SPACE[buf]
        begin = np.empty(len(buf) + 1, dtype=bool)
        begin[:-1] = solid
        begin[-1] = False
        edge = begin.copy()
        edge[1:-1] &= ~solid[:-1]
        inner = offsets[(offsets > 0) & (offsets < len(buf))]
        edge[inner] = begin[inner]
        self.starts = np.flatnonzero(edge)
        last = np.empty(len(buf), dtype=bool)
        if len(buf):
            last[:-1] = solid[:-1] & ~solid[1:]
            last[-1] = solid[-1]
            last[inner - 1] = solid[inner - 1]
        self.ends = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self, buf: np.ndarray) -> np.ndarray:
        """One well-mixed 64-bit hash per word."""
        n = len(self.starts)
        if n == 0:
            return np.zeros(0, np.uint64)
        length = self.ends - self.starts
        table = powers(int(length.max()))
        # position within the word, for word bytes only (spaces get weight 0 through reduceat on packed bytes)
        total = int(length.sum())
        packed_start = np.cumsum(length) - length
        shift = np.repeat(self.starts - packed_start, length)
        at = np.arange(total)
        vals = buf[at + shift].astype(np.uint64) + np.uint64(1)
        vals *= table[at - np.repeat(packed_start, length)]
        return mix(np.add.reduceat(vals, packed_start) + length.astype(np.uint64) * _M1)


def shingle_hashes(word_hash: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` consecutive words; window i starts at word i."""
    n = len(word_hash) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    table = powers(width)
    out = word_hash[:n] * table[0]
    for k in range(1, width):
        out = out + word_hash[k : k + n] * table[k]
    return mix(out + np.uint64(width))


def whole_hash(word_hash: np.ndarray) -> np.ndarray:
    """One hash for a sequence shorter than a shingle."""
    n = len(word_hash)
    return mix(np.array([np.add.reduce(word_hash * powers(n)) + np.uint64(n)], dtype=np.uint64))
