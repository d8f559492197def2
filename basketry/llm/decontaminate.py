"""Benchmark decontamination by spaced-seed hashing.

Words are runs of letters and digits of any script, A-Z lower-cased, so
punctuation (of any script) and markup do not hide a passage; each character of
a script that is written without spaces (``UNSPACED``) is a word of its own. A
document is contaminated by a benchmark item if some ``WINDOW`` consecutive
words of it equal the same number of the item's words in all but at most
``SUBSTITUTIONS`` places.

Each mask hashes the words at its 1 positions and ignores the others. The two
masks are lossless for the rule: wherever two words of a window differ, one
mask has a placement inside it that avoids both (a test tries all pairs). The
hashes of documents and items are joined, and around each hit the aligned
words are compared, over all windows that contain the hit.

Shorter items: 8 to 12 words are looked for as a whole with at most one
substitution (one half is then intact: a mask of half the words is lossless),
5 to 7 words as a whole without; of an item of 1 to 4 words, which common prose
may hold, only a document with these words and no others is a copy. Items
without words and null texts are never matched.

The items' words are broadcast while there are at most ``MAX_BROADCAST_WORDS``
of them (a few ten MB); then hits are verified where the documents are read
and nothing is shuffled but the findings. Larger benchmark tables go through a
shuffled join of the hashes, which carry the words around them; the findings
are the same.

Rows that share a doc_id are taken together, rows without one too; repeated
items and items that share an id count once. Empty tables give no rows. Columns
other than the ids and texts are not read (``drop_contaminated`` keeps them,
whatever their names). A text longer than a block is a block of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.text import LOWER, Words, blocks, mix, text_buffer
from basketry.llm.workdir import fresh

WINDOW = 13
SUBSTITUTIONS = 2
MASKS = ("11101011", "110100111")
MIN_ITEM_WORDS = 5           # shorter items: as whole documents only
ONE_SUBSTITUTION = 8         # from so many words on
MAX_BROADCAST_WORDS = 1_000_000
_FOUND = "doc_id long, text_hash long, item_id long, first_word long, windows long, matching_words int"

# every ASCII character that is no letter or digit parts words
_WORD_BYTES = np.array([LOWER[c] if c >= 128 or chr(c).isalnum() else 32 for c in range(256)], np.uint8)
# first and last code points of scripts without spaces (Thai and Lao, Myanmar,
# Khmer, kana and CJK, Yi), and of punctuation and symbols beyond ASCII
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3040, 0x31FF), (0x3400, 0x4DBF),
            (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF)]
PARTING = [(0x80, 0xA9), (0xAB, 0xB4), (0xB6, 0xB9), (0xBB, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x1680, 0x1680), (0x2000, 0x206F), (0x20A0, 0x20CF),
           (0x2190, 0x2BFF), (0x3000, 0x3004), (0x3008, 0x303F), (0xFE30, 0xFE4F), (0xFEFF, 0xFEFF), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20),
           (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)]


def _kind_table() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for kind, ranges in ((1, UNSPACED), (2, PARTING)):
        for a, b in ranges:
            out[a:b + 1] = kind
    return out


_KIND = _kind_table()


def word_bytes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts with what parts words as spaces, and
    spaces around each character of a script without them."""
    data, offsets = _WORD_BYTES[raw[offsets[0]:offsets[-1]]], offsets - offsets[0]
    lead = np.flatnonzero(data >= 0xC2)
    if not len(lead):
        return data, offsets
    size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
    wide = np.append(data, np.zeros(3, np.uint8)).astype(np.int64) & 63
    point = np.select([size == 2, size == 3], [(data[lead] & 31).astype(np.int64) << 6 | wide[lead + 1],
                                               (data[lead] & 15).astype(np.int64) << 12 | wide[lead + 1] << 6 | wide[lead + 2]],
                      (data[lead] & 7).astype(np.int64) << 18 | wide[lead + 1] << 12 | wide[lead + 2] << 6 | wide[lead + 3])
    kind = _KIND[point]
    for k in range(4):
        data[lead[(kind == 2) & (size > k)] + k] = 32
    alone = np.flatnonzero(kind == 1)
    if not len(alone):
        return data, offsets
    at = np.sort(np.concatenate((lead[alone], lead[alone] + size[alone])))
    return np.insert(data, at, 32), offsets + np.searchsorted(at, offsets)


@dataclass(frozen=True)
class Probe:
    """Word offsets to hash, in windows of ``window`` words with at most
    ``substitutions`` differing."""

    offsets: tuple[int, ...]
    window: int
    substitutions: int

    @property
    def span(self) -> int:
        return self.offsets[-1] + 1

    @property
    def reach(self) -> int:
        """Words before the hit that a window around it may hold."""
        return self.window - self.span


LONG = tuple(Probe(tuple(i for i, c in enumerate(m) if c == "1"), WINDOW, SUBSTITUTIONS) for m in MASKS)


def whole(words: int) -> Probe:
    """For items of ``words`` words, under WINDOW."""
    if words < ONE_SUBSTITUTION:
        return Probe(tuple(range(words)), words, 0)
    return Probe(tuple(range(words // 2)), words, 1)


def _fits(probe: Probe, hashed: Hashed, at: np.ndarray, item: bool) -> np.ndarray:
    """Whether a text of these words may be looked for with the probe, or in."""
    size = hashed.counts[hashed.doc[at]]
    if item:
        return size >= WINDOW if probe in LONG else size == probe.window
    return size >= probe.window if probe.window >= MIN_ITEM_WORDS else size == probe.window


class Hashed:
    """Word hashes of a block of texts, with each word's document bounds."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        w = Words(*word_bytes(raw, offsets))
        self.words, self.doc, self.counts = w.hashes(), w.doc(), w.counts
        self.first = np.repeat(w.first[:-1], w.counts)
        self.last = np.repeat(w.first[1:], w.counts)

    def seeds(self, probe: Probe) -> tuple[np.ndarray, np.ndarray]:
        """(word index, hash) of every placement of the probe."""
        at = np.flatnonzero(np.arange(len(self.words)) + probe.span <= self.last)
        total = np.zeros(len(at), np.uint64)
        for k, o in enumerate(probe.offsets):
            total += self.words[at + o] * np.uint64(2 * k + 0x9E3779B97F4A7C15)
        return at, mix(total + np.uint64(probe.window * 64 + probe.span))


def _windows(equal: np.ndarray, inside: np.ndarray, probe: Probe) -> np.ndarray:
    """Equal words of each pair in each window around the hit, or -1 where the
    rule is not met; from the equality of the aligned words at the offsets
    -reach..window-1 and whether both texts reach there."""
    sums = np.concatenate((np.zeros((len(equal), 1), int), np.cumsum(equal & inside, axis=1)), axis=1)
    valid = np.concatenate((np.zeros((len(equal), 1), int), np.cumsum(inside, axis=1)), axis=1)
    w, starts = probe.window, probe.reach + 1
    same = sums[:, w:w + starts] - sums[:, :starts]
    full = valid[:, w:w + starts] - valid[:, :starts] == w
    return np.where(full & (same >= w - probe.substitutions), same, -1)


class Benchmark:
    """Seeds of all items, looked up in sorted order."""

    def __init__(self, item_ids: np.ndarray, hashed: Hashed):
        self.item_ids, self.hashed = item_ids, hashed
        self.probes: list[tuple[Probe, np.ndarray, np.ndarray, np.ndarray]] = []
        short = [whole(int(n)) for n in np.unique(hashed.counts) if 0 < n < WINDOW]
        for probe in (*LONG, *short):
            at, seeds = hashed.seeds(probe)
            ok = _fits(probe, hashed, at, True)
            at, seeds = at[ok], seeds[ok]
            order = np.argsort(seeds, kind="stable")
            # one bit a hash prefix: most positions of a document end here
            sieve = np.zeros(1 << 22, bool)
            sieve[(seeds >> np.uint64(42)).astype(np.int64)] = True
            if len(at):
                self.probes.append((probe, seeds[order], at[order], sieve))

    def findings(self, h: Hashed):
        """(document, item, window start, equal words) of all verified windows."""
        out = []
        for probe, seeds, places, sieve in self.probes:
            at, hashes = h.seeds(probe)
            near = np.flatnonzero(sieve[(hashes >> np.uint64(42)).astype(np.int64)] & _fits(probe, h, at, False))
            at, hashes = at[near], hashes[near]
            lo, hi = np.searchsorted(seeds, hashes, "left"), np.searchsorted(seeds, hashes, "right")
            n = hi - lo
            i = np.repeat(at, n)
            j = places[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            b = self.hashed
            step = np.arange(-probe.reach, probe.window)
            ii, jj = i[:, None] + step, j[:, None] + step
            inside = ((ii >= h.first[i][:, None]) & (ii < h.last[i][:, None])
                      & (jj >= b.first[j][:, None]) & (jj < b.last[j][:, None]))
            equal = h.words[np.clip(ii, 0, max(len(h.words) - 1, 0))] == b.words[np.clip(jj, 0, max(len(b.words) - 1, 0))]
            same = _windows(equal, inside, probe)
            pair, k = np.nonzero(same >= 0)
            start = i[pair] - probe.reach + k
            out.append(np.stack([h.doc[i[pair]], b.doc[j[pair]], start, same[pair, k]], axis=1))
        found = np.concatenate(out) if out else np.zeros((0, 4), int)
        return np.unique(found, axis=0)


def _with_broadcast(texts: DataFrame, items: list) -> DataFrame:
    raw, offsets = text_buffer(pa.array([r["text"] for r in items], pa.string()))
    bench = texts.sparkSession.sparkContext.broadcast(
        Benchmark(np.array([r["item_id"] for r in items], np.int64), Hashed(raw, offsets)))

    def find(batches):
        for b in batches:
            ids, hashes = b.column(0), b.column(1)
            raw, offsets = text_buffer(b.column(2))
            for lo, hi in blocks(offsets):
                h = Hashed(raw, offsets[lo:hi + 1])
                f = bench.value.findings(h)
                if not len(f):
                    continue
                item = bench.value.item_ids[f[:, 1]]
                order = np.lexsort((f[:, 2], item, f[:, 0]))
                f, item = f[order], item[order]
                new = np.flatnonzero(np.concatenate(([True], (f[1:, 0] != f[:-1, 0]) | (item[1:] != item[:-1]))))
                # items may repeat an id: a window start counts once
                once = np.concatenate(([True], (np.diff(f[:, 2]) != 0) | (np.diff(f[:, 0]) != 0) | (np.diff(item) != 0)))
                start = f[new, 2] - np.concatenate(([0], np.cumsum(h.counts)))[f[new, 0]]
                doc = pa.array(f[new, 0] + lo)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(doc), hashes.take(doc), pa.array(item[new]), pa.array(start),
                     pa.array(np.add.reduceat(once.astype(np.int64), new)),
                     pa.array(np.maximum.reduceat(f[:, 3], new).astype(np.int32))],
                    ["doc_id", "text_hash", "item_id", "first_word", "windows", "matching_words"])

    return texts.mapInArrow(find, _FOUND)


def _seed_rows(texts: DataFrame, probes: tuple[Probe, ...], item: bool) -> DataFrame:
    """probe, seed, id, text_hash, at and the hashes of the words around."""

    def run(batches):
        for b in batches:
            raw, offsets = text_buffer(b.column(2))
            for lo, hi in blocks(offsets, 1 << 18):
                h = Hashed(raw, offsets[lo:hi + 1])
                begin = np.concatenate(([0], np.cumsum(h.counts)))
                for k, probe in enumerate(probes):
                    at, seeds = h.seeds(probe)
                    ok = _fits(probe, h, at, item)
                    at, seeds = at[ok], seeds[ok]
                    step = at[:, None] + np.arange(-probe.reach, probe.window)
                    inside = (step >= h.first[at][:, None]) & (step < h.last[at][:, None])
                    # a word's hash, or 0 outside of the text (words never hash to 0 here)
                    around = np.where(inside, h.words[np.clip(step, 0, max(len(h.words) - 1, 0))] | np.uint64(1), np.uint64(0))
                    doc = pa.array(h.doc[at] + lo)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), k, np.int32)), pa.array(seeds.view(np.int64)), b.column(0).take(doc),
                         b.column(1).take(doc), pa.array(at - begin[h.doc[at]]),
                         pa.array([r.tobytes() for r in around], pa.binary())],
                        ["probe", "seed", "id", "text_hash", "at", "around"])

    return texts.mapInArrow(run, "probe int, seed long, id long, text_hash long, at long, around binary")


def _with_join(texts: DataFrame, items: DataFrame) -> DataFrame:
    probes = (*LONG, *(whole(n) for n in range(1, WINDOW)))
    left = _seed_rows(texts, probes, False)
    right = _seed_rows(items, probes, True).select(
        "probe", "seed", F.col("id").alias("item_id"), F.col("around").alias("expected"))

    def verify(batches):
        for b in batches:
            kind = b.column(0).to_numpy(zero_copy_only=False)
            for k in np.unique(kind):
                rows = pa.array(np.flatnonzero(kind == k))
                part = b.take(rows)
                shape = (part.num_rows, probes[k].reach + probes[k].window)
                ours, theirs = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint64).reshape(shape) for c in (5, 6))
                same = _windows(ours == theirs, (ours != 0) & (theirs != 0), probes[k])
                pair, w = np.nonzero(same >= 0)
                take = pa.array(pair)
                start = part.column(4).to_numpy(zero_copy_only=False)[pair] - probes[k].reach + w
                yield pa.RecordBatch.from_arrays(
                    [part.column(1).take(take), part.column(2).take(take), part.column(3).take(take), pa.array(start),
                     pa.array(same[pair, w].astype(np.int32))], ["doc_id", "text_hash", "item_id", "start", "same"])

    found = (left.join(right, ["probe", "seed"])
             .select("probe", F.col("id").alias("doc_id"), "text_hash", "item_id", "at", "around", "expected")
             .mapInArrow(verify, "doc_id long, text_hash long, item_id long, start long, same int"))
    return (found.groupBy("doc_id", "text_hash", "item_id", "start").agg(F.max("same").alias("same"))
            .groupBy("doc_id", "text_hash", "item_id")
            .agg(F.min("start").alias("first_word"), F.count("start").alias("windows"),
                 F.max("same").alias("matching_words")))


def _findings(docs: DataFrame, benchmark: DataFrame, max_words: int) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                        F.col("text").cast("string").alias("text"))
    items = benchmark.where(F.col("text").isNotNull()).select(
        F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("text_hash"),
        F.col("text").cast("string").alias("text"))
    # a word takes two bytes at least
    size = items.agg(F.sum((F.octet_length("text") + 1) / 2)).first()[0] or 0
    if size <= max_words and not items.where("item_id is null").limit(1).count():
        return _with_broadcast(texts, items.distinct().collect())
    return _with_join(texts, items)


def contaminated(docs: DataFrame, benchmark: DataFrame, max_broadcast_words: int = MAX_BROADCAST_WORDS) -> DataFrame:
    """doc_id, item_id, first_word, windows, matching_words: one row for each
    document and item with a verified overlap (``first_word``: where the first
    window starts; ``windows``: how many do; ``matching_words``: equal words in
    the best). Rows that share a doc_id are taken together."""
    return (_findings(docs, benchmark, max_broadcast_words).groupBy("doc_id", "item_id")
            .agg(F.min("first_word").alias("first_word"), F.max("windows").alias("windows"),
                 F.max("matching_words").alias("matching_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame,
                      max_broadcast_words: int = MAX_BROADCAST_WORDS) -> DataFrame:
    """``docs`` (all columns) without the contaminated rows."""
    key, th = fresh(docs, "_key", "_th")
    none = F.lit(-(1 << 63))
    gone = (_findings(docs, benchmark, max_broadcast_words)
            .select(F.coalesce("doc_id", none).alias(key), F.col("text_hash").alias(th)).distinct())
    return (docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), none), th: F.xxhash64("text")})
            .join(gone, [key, th], "left_anti").drop(key, th))
