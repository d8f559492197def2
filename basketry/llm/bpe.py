"""Byte-level BPE ids for whole blocks of texts.

The vocabulary is a public byte-level BPE file (``tokenizers`` JSON), given by
path. Texts are cut into pre-tokens by that family's pattern (contractions,
letters, digits, other signs, white space; one space may lead), found for a
whole block at once from the code points' kinds. Each different pre-token is
merged once and kept in a bounded cache; a block's ids are then gathered.
Texts are first cut at the file's added tokens (``<|endoftext|>``), which have
ids of their own. Ids equal those of ``tokenizers`` with
``add_special_tokens=False``: ``encode`` those with ``encode_special_tokens``
on (such strings are ordinary text), ``encode_added`` those of its default.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np

from basketry.llm.text import _BYTES, U, _prefix, range_hash

# the pattern of this tokenizer family, and the white space it knows: fixed values
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

OTHER, LETTER, NUMBER, SPACE = range(4)
CACHE_ENTRIES = 1_000_000


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        major = unicodedata.category(chr(c))[0]
        if major == "L":
            out[c] = LETTER
        elif major == "N":
            out[c] = NUMBER
    out[list(WHITE_SPACE)] = SPACE
    return out


def byte_of_char() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in the vocabulary file: printable
    Latin-1 bytes stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def pretoken_starts(points: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """True at the code points where a pre-token starts. ``cuts``: True where
    a text starts (one entry more than points)."""
    n = len(points)
    kind = _kinds()[points]
    edge = cuts[:n].copy()
    edge[1:] |= kind[1:] != kind[:-1]
    starts = edge.copy()
    after_space = np.zeros(n, bool)                     # the char before is ' ', in the same text
    after_space[1:] = (points[:-1] == 32) & ~cuts[1:n]
    space = kind == SPACE
    word = np.flatnonzero(edge & ~space)                # first of a run that is not white space
    joined = word[after_space[word]]
    starts[joined] = False
    # the last white space before a word is a token of its own or leads the word
    led = word[(word > 0) & ~cuts[word]]
    led = led[space[led - 1]]
    starts[led - 1] = True
    # contractions: a lone apostrophe that starts a token, and the letters after it
    for i in np.flatnonzero((points == 39) & starts):
        if i + 1 >= n or cuts[i + 1] or kind[i + 1] != LETTER:
            continue
        for suffix in CONTRACTIONS:
            end = i + 1 + len(suffix)
            if end <= n and not cuts[i + 2:end].any() and "".join(map(chr, points[i + 1:end])) == suffix:
                starts[i + 1] = False
                if end < n and not edge[end]:
                    starts[end] = True
                break
    return starts


class BlockTokenizer:
    """Encodes blocks of texts; ``path``: the vocabulary file."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        added = file.get("added_tokens") or []
        for token in added:
            if token["single_word"] or token["lstrip"] or token["rstrip"]:
                raise ValueError(f"added token {token['content']!r}: only plain matching is supported")
        self._added = {token["content"].encode(): token["id"] for token in added}
        # the longest one that starts leftmost
        longest = sorted(self._added, key=len, reverse=True)
        self._added_pattern = re.compile(b"|".join(map(re.escape, longest))) if longest else None
        chars = byte_of_char()
        ranks = {bytes(chars[c] for c in token): rank for token, rank in model["vocab"].items()
                 if all(c in chars for c in token)}
        special = [token for token in model["vocab"] if token.startswith("<|") and token.endswith("|>")]
        for token in special:
            ranks.pop(token.encode(), None)
        self._encoding = tiktoken.Encoding("block", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._forget()

    def _forget(self) -> None:
        self._known = np.zeros(0, U)
        self._at = np.zeros(0, np.int64)
        self._size = np.zeros(0, np.int64)
        self._ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        found = [self._encoding._encode_single_piece(p) for p in pieces]
        size = np.fromiter(map(len, found), np.int64, len(found))
        at = len(self._ids) + np.cumsum(size) - size
        self._ids = np.concatenate((self._ids, np.fromiter((x for f in found for x in f), np.uint32, int(size.sum()))))
        known = np.concatenate((self._known, hashes))
        order = np.argsort(known, kind="stable")
        self._known = known[order]
        self._at = np.concatenate((self._at, at))[order]
        self._size = np.concatenate((self._size, size))[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        offsets = offsets - offsets[0]
        texts = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(texts, np.int64)
        raw = data.tobytes()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)           # byte position of every code point
        bounds = np.searchsorted(lead, offsets)
        cuts = np.zeros(len(points) + 1, bool)
        cuts[bounds] = True
        start = np.flatnonzero(pretoken_starts(points, cuts))
        end = np.append(start[1:], len(points))
        prefix = _prefix(points.astype(U) + U(1), _BYTES)
        hashes = range_hash(prefix, start, end, _BYTES)
        different, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self._known) > CACHE_ENTRIES:
            self._forget()
        at = np.searchsorted(self._known, different)
        new = np.ones(len(different), bool)
        inside = at < len(self._known)
        new[inside] = self._known[at[inside]] != different[inside]
        if new.any():
            byte = np.append(lead, len(raw))
            f = first[new]
            self._learn(different[new], [raw[a:b] for a, b in zip(byte[start[f]].tolist(), byte[end[f]].tolist(), strict=True)])
            at = np.searchsorted(self._known, different)
        size, base = self._size[at][which], self._at[at][which]
        total = np.cumsum(size)
        ids = self._ids[np.repeat(base - (total - size), size) + np.arange(total[-1])]
        per_text = np.concatenate(([0], total))[np.searchsorted(start, bounds)]
        return ids, np.diff(per_text)

    def encode_added(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with the file's added tokens as ids of their own; the
        parts of a text between them are encoded each by itself."""
        offsets = offsets - offsets[0]
        raw = data.tobytes()
        if self._added_pattern is None or not self._added_pattern.search(raw):
            return self.encode(data, offsets)
        keep = np.ones(len(data), bool)
        bounds, follow, special = [0], [], []          # ends of the parts, parts before a token, its id
        parts = np.zeros(len(offsets), np.int64)       # parts before each text
        tokens = np.zeros(len(offsets) - 1, np.int64)
        gone = 0
        for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            for m in self._added_pattern.finditer(raw, lo, hi):
                a, b = m.span()
                follow.append(len(bounds) - 1)
                special.append(self._added[m.group()])
                bounds.append(a - gone)
                keep[a:b] = False
                gone += b - a
                tokens[i] += 1
            bounds.append(hi - gone)
            parts[i + 1] = len(bounds) - 1
        ids, counts = self.encode(data[keep], np.array(bounds, np.int64))
        after = np.concatenate(([0], np.cumsum(counts)))
        ids = np.insert(ids, after[np.array(follow, np.int64) + 1], np.array(special, np.uint32))
        return ids, np.diff(after[parts]) + tokens


@lru_cache(maxsize=2)
def tokenizer(path: str) -> BlockTokenizer:
    """One tokenizer, with its cache, for each Python worker."""
    return BlockTokenizer(path)
