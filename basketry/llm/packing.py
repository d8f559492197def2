"""Sequence packing as a cutting-stock problem.

1. Every document is tokenised (plus an end token) and cut into whole
   sequences' worth of ids and a remainder.
2. The pieces' lengths, rounded up to a grain, form a histogram of at most
   ``capacity / grain`` classes: all that the driver ever sees, whatever the
   number of documents.
3. Column generation: the linear program over patterns (how many pieces of
   each class share a sequence) is solved with a growing set of patterns; its
   dual prices are handed to a knapsack dynamic program, which finds the best
   new pattern until none improves the bound.
4. The pattern counts are rounded down and the few pieces left over are placed
   best fit first, so every class's demand is met exactly.
5. Pieces are ranked within their class (counted in buckets, so that one very
   common length is spread over tasks), and the rank names the sequence and
   the place in it. Offsets are running sums of true lengths in a sequence.

Null text: the end token alone. Repeated rows and rows with a null doc_id are
packed like any others; equal lengths are ranked by doc_id, text hash and start,
and rows that tie there in any order. An empty table gives no rows. Columns
other than doc_id and text are not read, whatever their names. A text longer
than a block is a block of its own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.bpe import tokenizer
from basketry.llm.text import blocks, text_buffer
from basketry.llm.workdir import saved

CAPACITY = 2048
GRAIN = 16
END_ID = 1
PIECES_PER_BUCKET = 50_000
GAP = 2e-3              # column generation stops this near a lower bound


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID,
           with_ids: bool = True) -> DataFrame:
    """doc_id, text_hash, start, length, doc_tokens, ids_crc32 and, if asked,
    ids of every piece."""
    schema = ("doc_id long, text_hash long, start long, length long, doc_tokens long, ids_crc32 long"
              + (", ids array<int>" if with_ids else ""))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        encode = tokenizer(vocabulary).encode_added
        for b in batches:
            raw, offsets = text_buffer(b.column(2))
            for lo, hi in blocks(offsets):
                flat, counts = encode(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1])
                after = np.cumsum(counts)
                ids = np.insert(flat, after, np.uint32(end_id))
                total = counts + 1
                per_doc = -(-total // capacity)
                row = np.repeat(np.arange(len(total)), per_doc)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)) * capacity
                length = np.minimum(total[row] - start, capacity)
                begin = (np.cumsum(total) - total)[row] + start
                little = ids.astype("<u4")
                crc = [zlib.crc32(little[a:a + n]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
                take = pa.array(row + lo)
                columns = [b.column(0).take(take), b.column(1).take(take), pa.array(start), pa.array(length),
                           pa.array(total[row]), pa.array(np.array(crc, np.int64))]
                if with_ids:      # a text's pieces cover its ids in order
                    columns.append(pa.ListArray.from_arrays(
                        pa.array(np.append(begin, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    return (docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), F.col("text").cast("string"))
            .mapInArrow(run, schema))


def best_pattern(prices: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of classes 1..room units with the
    highest sum of prices that fits ``room`` units."""
    value = np.zeros(room + 1)
    choice = np.zeros(room + 1, int)
    for k in range(1, room + 1):
        with_class = prices[:k] + value[k - 1::-1][:k]           # class c leaves k - c units
        c = int(np.argmax(with_class))
        if with_class[c] > value[k - 1]:
            value[k], choice[k] = with_class[c], c + 1
        else:
            value[k] = value[k - 1]
    pattern, k = np.zeros(room, int), room
    while k > 0:
        if choice[k]:
            pattern[choice[k] - 1] += 1
            k -= choice[k]
        else:
            k -= 1
    return float(value[room]), pattern


def cutting_stock(demand: np.ndarray, gap: float = GAP) -> list[tuple[int, np.ndarray]]:
    """(repetitions, pattern) pairs that meet ``demand`` exactly; ``demand[c-1]``
    pieces of c units go into sequences of ``len(demand)`` units."""
    room = len(demand)
    used = np.flatnonzero(demand)      # (einsum below: no BLAS threads in the driver for these small steps)
    if not len(used):
        return []
    m = len(used)
    patterns = np.zeros((m, room), int)
    patterns[np.arange(m), used] = room // (used + 1)
    inverse = np.diag(1.0 / patterns[np.arange(m), used])         # of the basis, classes x patterns
    want = demand[used].astype(float)
    amount = inverse @ want
    volume = float(((used + 1) * want).sum()) / room              # no packing needs less
    for _ in range(50 * m):        # rounding errors are harmless: counts are made exact below
        if amount.sum() <= volume * (1 + gap):
            break
        prices = np.zeros(room)
        prices[used] = inverse.sum(axis=0)
        best, pattern = best_pattern(prices, room)
        if best <= 1 + gap:        # the optimum is at least sum(amount) / best
            break
        column = np.einsum("ij,j->i", inverse, pattern[used].astype(float))
        ratio = np.where(column > 1e-9, amount / np.where(column > 1e-9, column, 1), np.inf)
        out = int(np.argmin(ratio))
        patterns[out] = pattern
        pivot = inverse[out] / column[out]
        inverse -= np.outer(column, pivot)
        inverse[out] = pivot
        amount = np.maximum(np.einsum("ij,j->i", inverse, want), 0)
    return _whole(np.floor(amount + 1e-9).astype(int), patterns, demand)


def _whole(counts: np.ndarray, patterns: np.ndarray, demand: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Rounded counts of ``patterns``, and best fit for the rest. Where rounding
    errors exceed a demand, patterns that hold the class give way one at a
    time."""
    counts, patterns = np.array(counts, int), np.asarray(patterns)
    left = demand - counts @ patterns
    while (left < 0).any():
        c = int(np.argmin(left))
        k = int(np.flatnonzero((counts > 0) & (patterns[:, c] > 0))[0])
        counts[k] -= 1
        left = left + patterns[k]
    return [(int(n), p) for n, p in zip(counts, patterns, strict=True) if n] + _best_fit(left)


def _best_fit(left: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Best fit decreasing for the pieces that rounding left over."""
    room = len(left)
    by_room: list[list[np.ndarray]] = [[] for _ in range(room + 1)]
    for c in range(room, 0, -1):
        for _ in range(int(left[c - 1])):
            free = next((k for k in range(c, room + 1) if by_room[k]), None)
            pattern = by_room[free].pop() if free is not None else np.zeros(room, int)
            pattern[c - 1] += 1
            by_room[(free if free is not None else room) - c].append(pattern)
    return [(1, p) for group in by_room for p in group]


class Assignment:
    """From (class, rank within the class) to (sequence, place in it)."""

    def __init__(self, plan: list[tuple[int, np.ndarray]], room: int):
        starts = [[] for _ in range(room)]
        taken = np.zeros(room, np.int64)
        base = 0
        for n, pattern in plan:
            place = 0
            for c in np.flatnonzero(pattern):
                starts[c].append((taken[c], base, int(pattern[c]), place))
                taken[c] += n * pattern[c]
                place += int(pattern[c])
            base += n
        self.sequences = base
        self.tables = [np.array(s, np.int64).reshape(-1, 4) for s in starts]

    def of(self, cls: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, place = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for c in np.unique(cls):
            rows = np.flatnonzero(cls == c)
            table = self.tables[c - 1]
            t = table[np.searchsorted(table[:, 0], rank[rows], "right") - 1]
            k = rank[rows] - t[:, 0]
            sequence[rows] = t[:, 1] + k // t[:, 2]
            place[rows] = t[:, 3] + k % t[:, 2]
        return sequence, place


def pack(found: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """Pieces (``doc_id, text_hash, start, length`` and any further columns)
    with ``sequence_id`` and ``offset``."""
    room = capacity // grain
    cls = F.ceil(F.col("length") / F.lit(grain)).cast("int")
    # at most `room` rows
    histogram = {r["cls"]: r["n"] for r in found.groupBy(cls.alias("cls")).agg(F.count(F.lit(1)).alias("n")).collect()}
    demand = np.array([histogram.get(c, 0) for c in range(1, room + 1)])
    assignment = Assignment(cutting_stock(demand), room)
    buckets = max(256, int(demand.sum()) // PIECES_PER_BUCKET)
    keyed = found.withColumns({"_class": cls, "_bucket": F.pmod(F.xxhash64("doc_id", "text_hash", "start"), F.lit(buckets))})
    ranked = keyed.withColumn("_nth", F.row_number().over(
        Window.partitionBy("_class", "_bucket").orderBy("doc_id", "text_hash", "start")))
    before = Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keyed.groupBy("_class", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_class", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = (ranked.join(sizes, ["_class", "_bucket"])
              .withColumn("_rank", F.col("_before") + F.col("_nth") - 1))
    places = ranked.select(*found.columns, "_class", "_rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, _place long"

    def place(batches):
        for b in batches:
            k = len(b.columns)
            sequence, at = assignment.of(b.column(k - 2).to_numpy(zero_copy_only=False),
                                         b.column(k - 1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*b.columns[:k - 2], pa.array(sequence), pa.array(at)],
                                             [*b.schema.names[:k - 2], "sequence_id", "_place"])

    inside = Window.partitionBy("sequence_id").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    return (places.mapInArrow(place, schema)
            .withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long")).drop("_place"))


def pack_pieces(found: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """``pack`` for pieces that carry their ids: only the lengths go through
    the ranking, and the ids are shuffled once, to meet their places."""
    if "ids" not in found.columns:
        return pack(found, capacity, grain)
    placed = pack(found.drop("ids", "ids_crc32", "doc_tokens"), capacity, grain)
    return (found.join(placed.select("piece", "sequence_id", "offset"), "piece")
            .select(*found.columns, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, grain: int = GRAIN,
                   end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """doc_id, text_hash, start, length, doc_tokens, ids_crc32[, ids],
    sequence_id, offset: every id of every document in exactly one piece."""
    found = pieces(docs, vocabulary, capacity, end_id, with_ids).withColumn("piece", F.monotonically_increasing_id())
    return pack_pieces(saved(found, "packing-pieces"), capacity, grain).drop("piece")


def padded_sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = END_ID) -> DataFrame:
    """sequence_id and its ``capacity`` ids, padded at the end."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    ids = F.flatten(F.transform(parts, lambda p: p["ids"]))
    return (packed.groupBy("sequence_id").agg(ids.alias("ids"))
            .select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(capacity) - F.size("ids"))).alias("ids")))
