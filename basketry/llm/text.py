"""Vectorised helpers over the UTF-8 bytes of a whole Arrow batch of texts.

Words are maximal runs of bytes other than space and ``\\t \\n \\v \\f \\r``.
Every helper works on a block of documents at a time (``blocks``), so a task
holds a few MB of numpy arrays however large the Arrow batch is; a single
document larger than a block is a block of its own. All functions are pure
numpy: Spark partitions and shuffles the rows, these run inside its tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BLOCK_BYTES = 1 << 20
# characters that end a word, and the A-Z lower-casing, as byte tables
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_SEP = np.zeros(256, bool)
IS_SEP[list(SEPARATORS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
UPPER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_AZ = UPPER_AZ.lower()

_BASE_BYTE = 0x9E3779B97F4A7C55     # odd: invertible modulo 2**64
_BASE_WORD = 0xD1B54A32D192ED03


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, b in (("up", self.base), ("down", self.inverse)):
                out = np.full(size, b, U)
                out[0] = 1
                setattr(self, name, np.multiply.accumulate(out))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_BASE_BYTE), _Powers(_BASE_WORD)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: spreads a 64-bit value over all its bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _prefix(values: np.ndarray, powers: _Powers) -> np.ndarray:
    up, _ = powers.upto(len(values) + 1)
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[:-1], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray,
               powers: _Powers) -> np.ndarray:
    down = powers.upto(len(prefix))[1]
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type)
                              or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = (np.frombuffer(offs, kind)[column.offset:column.offset + len(column) + 1]
               .astype(np.int64) if len(column) else np.zeros(1, np.int64))
    raw = np.frombuffer(data, np.uint8) if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, offsets


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) of about ``size`` bytes, at least one row each."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


class Words:
    """The words of a block of texts.

    ``start``/``end``: byte range of every word in ``data``; ``first``: index
    of each document's first word (one more entry than documents).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.offsets = offsets - offsets[0]
        self.data = data[offsets[0]:offsets[-1]]
        if lower:
            self.data = LOWER[self.data]
        n = len(self.data)
        word = ~IS_SEP[self.data]
        cut = np.zeros(n + 1, bool)
        cut[self.offsets] = True
        begins = word.copy()
        begins[1:] &= ~word[:-1] | cut[1:-1]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | cut[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return range_hash(_prefix(self.data.astype(U) + U(1), _BYTES),
                          self.start, self.end, _BYTES)

    def doc(self) -> np.ndarray:
        """Index of each word's document."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of ``size`` words
        inside one document."""
        at = self.window_starts(size)
        return at, range_hash(_prefix(hashes, _WORDS), at, at + size, _WORDS)

    def window_starts(self, size: int) -> np.ndarray:
        last = np.repeat(self.first[1:], self.counts)
        at = np.arange(len(self.start))
        return at[at + size <= last]


def byte_windows(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of every ``size``-byte string inside one document."""
    pos = np.arange(len(data))
    last = np.repeat(offsets[1:], np.diff(offsets))
    pos = pos[pos + size <= last]
    return pos, range_hash(_prefix(data.astype(U) + U(1), _BYTES), pos, pos + size, _BYTES)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return x.view(np.int64)


def row_ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)
