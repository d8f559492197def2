"""Ids of short byte strings, each different one encoded once.

Public tokenizers spend most of their time on strings they have seen before.
Where a text can be cut into chunks that the tokenizer never joins, the ids of
a text are its chunks' ids in a row; a chunk's ids are asked for once and kept.
The library decides every id, this only gathers them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np

from basketry.llm.text import _BYTES, U, _prefix, range_hash

CACHE_ENTRIES = 1_000_000


class ChunkIds:
    """``encode``: ids of each of a list of byte strings (``encode_batch``
    is called with the strings not met before). At most ``CACHE_ENTRIES``
    strings and a block's worth are kept."""

    def __init__(self, encode_batch: Callable[[list[bytes]], Sequence[Sequence[int]]]):
        self._encode_batch = encode_batch
        self._forget()

    def _forget(self) -> None:
        self._known = np.zeros(0, U)
        self._at = np.zeros(0, np.int64)
        self._size = np.zeros(0, np.int64)
        self._ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        """``hashes`` ascend and are new."""
        found = self._encode_batch(chunks)
        size = np.fromiter(map(len, found), np.int64, len(found))
        at = len(self._ids) + np.cumsum(size) - size
        self._ids = np.concatenate((self._ids, np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))))
        place = np.searchsorted(self._known, hashes)
        self._known = np.insert(self._known, place, hashes)
        self._at = np.insert(self._at, place, at)
        self._size = np.insert(self._size, place, size)

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the chunks ``data[start:end]`` in a row, ids of each)."""
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self._known) > CACHE_ENTRIES:
            self._forget()
        hashes = range_hash(_prefix(data.astype(U) + U(1), _BYTES), start, end, _BYTES)
        different, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self._known, different)
        new = np.ones(len(different), bool)
        inside = at < len(self._known)
        new[inside] = self._known[at[inside]] != different[inside]
        if new.any():
            raw, f = data.tobytes(), first[new]
            self._learn(different[new], [raw[a:b] for a, b in zip(start[f].tolist(), end[f].tolist(), strict=True)])
            at = np.searchsorted(self._known, different)
        size, base = self._size[at][which], self._at[at][which]
        total = np.cumsum(size)
        return self._ids[np.repeat(base - (total - size), size) + np.arange(total[-1])], size
