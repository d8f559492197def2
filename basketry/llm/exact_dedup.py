"""Exact deduplication with counting quotient filters.

1. Every task fingerprints its whole texts (after lower-casing A-Z) and builds
   one counting quotient filter: the fingerprint's high bits (the quotient)
   name a slot, the low bits (the remainder) are kept sorted in the slot's
   run, and a counter says how often it was seen. Nothing is lost: quotient
   and remainder together are the fingerprint.
2. The filters leave the task cut into blocks of neighbouring quotients. All
   blocks of one number meet in one task and are merged in the order of their
   sorted remainders, adding counters. A text that fills a third of the table
   arrives once per map task, so no group of copies is ever gathered.
3. Only fingerprints counted more than once go on: the bytes of their texts
   are compared in full (a group by the whole normalised text, combined on
   the map side), so texts that merely share a fingerprint are told apart.

Null text counts as empty. Rows that repeat both a doc_id and an equal text
are one document and give one row; they still count in ``group_size``. A null
doc_id is smaller than any other. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.text import LOWER, text_buffer
from basketry.llm.workdir import fresh, saved

FINGERPRINT_BITS = 64
# fingerprints that one merge task gets at most, on average
FINGERPRINTS_PER_BLOCK = 1 << 20


class CountingQuotientFilter:
    """Sorted fingerprints as (occupied quotients, run ends, remainders,
    counters); ``to_bytes``/``from_bytes`` round-trip exactly."""

    def __init__(self, fingerprints: np.ndarray, counts: np.ndarray):
        self.fingerprints, self.counts = fingerprints, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray) -> CountingQuotientFilter:
        values, counts = np.unique(fingerprints, return_counts=True)
        return cls(values, counts.astype(np.uint64))

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Union of all runs, counters added: two filters at a time, the
        smallest ones first, each a linear merge of sorted remainders in
        quotient order."""
        heap = [(len(f.fingerprints), k, f) for k, f in enumerate(filters)]
        heapq.heapify(heap)
        if not heap:
            return cls(np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        while len(heap) > 1:
            (_, k, small), (_, _, large) = heapq.heappop(heap), heapq.heappop(heap)
            both = large._with(small)
            heapq.heappush(heap, (len(both.fingerprints), k, both))
        return heap[0][2]

    def _with(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        at = np.searchsorted(self.fingerprints, other.fingerprints)
        known = at < len(self.fingerprints)
        known[known] = self.fingerprints[at[known]] == other.fingerprints[known]
        counts = self.counts.copy()
        counts[at[known]] += other.counts[known]
        return CountingQuotientFilter(np.insert(self.fingerprints, at[~known], other.fingerprints[~known]),
                                      np.insert(counts, at[~known], other.counts[~known]))

    def blocks(self, block_bits: int, bits: int) -> Iterator[tuple[int, CountingQuotientFilter]]:
        number = (self.fingerprints >> np.uint64(bits - block_bits)
                  if block_bits else np.zeros(len(self.fingerprints), np.uint64))
        cuts = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1], [True]))) \
            if len(number) else np.zeros(1, int)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(number[lo]), CountingQuotientFilter(self.fingerprints[lo:hi], self.counts[lo:hi])

    def to_bytes(self, bits: int, remainder_bits: int) -> bytes:
        r = np.uint64(remainder_bits)
        quotients = self.fingerprints >> r
        remainders = self.fingerprints & ((np.uint64(1) << r) - np.uint64(1))
        base = int(quotients[0]) if len(quotients) else 0
        relative = (quotients - np.uint64(base)).astype(np.int64)
        occupied = np.zeros(int(relative[-1]) + 1 if len(relative) else 0, bool)
        occupied[relative] = True
        run_end = np.ones(len(relative), bool)
        run_end[:-1] = relative[1:] != relative[:-1]
        width = (remainder_bits + 7) // 8
        head = np.array([len(relative), len(occupied), base, remainder_bits], np.uint64)
        small = np.minimum(self.counts, 255).astype(np.uint8)     # 255: the full counter follows
        return b"".join((head.tobytes(), np.packbits(occupied).tobytes(), np.packbits(run_end).tobytes(),
                         np.ascontiguousarray(remainders.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes(),
                         small.tobytes(), self.counts[small == 255].tobytes()))

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountingQuotientFilter:
        n, spread, base, remainder_bits = (int(x) for x in np.frombuffer(raw, np.uint64, 4))
        at = 32

        def take(size: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(raw, np.uint8, size, at)
            at += size
            return part

        occupied = np.unpackbits(take((spread + 7) // 8), count=spread).astype(bool)
        run_end = np.unpackbits(take((n + 7) // 8), count=n).astype(bool)
        width = (remainder_bits + 7) // 8
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = take(n * width).reshape(n, width)
        remainders = wide.view(np.uint64).ravel()
        small = take(n)
        counts = small.astype(np.uint64)
        big = np.flatnonzero(small == 255)
        counts[big] = np.frombuffer(raw, np.uint64, len(big), at)
        run = np.concatenate(([0], np.cumsum(run_end)[:-1])) if n else np.zeros(0, int)
        quotients = np.flatnonzero(occupied)[run].astype(np.uint64) + np.uint64(base)
        return cls((quotients << np.uint64(remainder_bits)) | remainders, counts)


def normalised(column: pa.Array) -> Iterator[bytes]:
    """Whole texts as bytes, A-Z lower-cased."""
    raw, offsets = text_buffer(column)
    for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
        yield LOWER[raw[lo:hi]].tobytes()


def fingerprints(docs: DataFrame, bits: int = FINGERPRINT_BITS) -> DataFrame:
    """doc_id, raw_hash (of the text as it is), fingerprint (long) and
    text_sha256 (lowercase hex) of every row."""

    def run(batches):
        for b in batches:
            prints, sums = [], []
            for text in normalised(b.column(2)):
                prints.append(xxhash.xxh3_64_intdigest(text) >> (64 - bits))
                sums.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.array(prints, np.uint64).view(np.int64)),
                 pa.array(sums, pa.string())],
                ["doc_id", "raw_hash", "fingerprint", "text_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, raw_hash long, fingerprint long, text_sha256 string")


def repeated_fingerprints(prints: DataFrame, bits: int = FINGERPRINT_BITS) -> DataFrame:
    """fingerprint, copies: the fingerprints counted more than once."""
    rows = prints.count()
    block_bits = min(bits, max(4, (rows // FINGERPRINTS_PER_BLOCK).bit_length() + 2))
    # remainders of whole bytes; the quotient's bits below the block number
    # hold about one slot for each fingerprint
    remainder_bits = max(0, bits - max(block_bits, min(24, max(1, rows.bit_length()))))
    remainder_bits -= remainder_bits % 8

    def build(batches):
        # one filter per task, from all its fingerprints (8 bytes a row)
        parts = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches]
        if parts:
            whole = CountingQuotientFilter.of(np.concatenate(parts))
            for number, block in whole.blocks(block_bits, bits):
                yield pa.RecordBatch.from_pydict({"block": [number], "cqf": [block.to_bytes(bits, remainder_bits)]})

    def merge(table: pa.Table) -> pa.Table:
        whole = CountingQuotientFilter.merged(
            [CountingQuotientFilter.from_bytes(x) for x in table.column("cqf").to_pylist()])
        many = whole.counts > 1
        return pa.table({"fingerprint": whole.fingerprints[many].view(np.int64),
                         "copies": whole.counts[many].astype(np.int64)})

    blocks = prints.select("fingerprint").mapInArrow(build, "block long, cqf binary")
    return blocks.groupBy("block").applyInArrow(merge, "fingerprint long, copies long")


def exact_groups(docs: DataFrame, bits: int = FINGERPRINT_BITS) -> tuple[DataFrame, DataFrame]:
    """(fingerprints of all rows; verified groups of two rows or more:
    text_sha256, keep_id, group_size)."""
    prints = saved(fingerprints(docs, bits), "exact-fingerprints")
    repeated = repeated_fingerprints(prints, bits)
    suspects = prints.join(repeated, "fingerprint", "left_semi").select("doc_id").distinct()

    def lowered(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(list(normalised(b.column(1))), pa.binary())], ["doc_id", "body"])

    # every row of a suspect id comes along; a text seen once drops out again
    texts = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
             .join(suspects.withColumnRenamed("doc_id", "_s"), F.col("doc_id").eqNullSafe(F.col("_s")), "left_semi")
             .mapInArrow(lowered, "doc_id long, body binary"))
    groups = (texts.groupBy("body")
              .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
              .where("group_size > 1")
              .select(F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size"))
    return prints, groups


def _decided(prints: DataFrame, groups: DataFrame) -> DataFrame:
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return prints.join(groups, "text_sha256", "left").select(
        *prints.columns, keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"))


def exact_dedup(docs: DataFrame, bits: int = FINGERPRINT_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per document;
    of equal texts the row with the largest doc_id is kept."""
    prints, groups = exact_groups(docs, bits)
    return (_decided(prints.select("doc_id", "text_sha256").distinct(), groups)
            .select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))


def drop_exact_copies(docs: DataFrame, bits: int = FINGERPRINT_BITS) -> DataFrame:
    """``docs`` (all columns) with one row of each group of equal texts."""
    prints, groups = exact_groups(docs, bits)
    key, raw = fresh(docs, "_key", "_raw")
    some = F.lit(-(1 << 63))
    # both sides of the join on texts are plain scans and its result is
    # written, so that Spark can split the rows of a hot text
    decided = saved(_decided(prints, saved(groups, "exact-groups")).where("kept").select("doc_id", "text_sha256", "raw_hash"), "exact-kept")
    kept = (decided.groupBy("doc_id", "text_sha256").agg(F.max("raw_hash").alias(raw))
            .select(F.coalesce("doc_id", some).alias(key), raw))
    # the second step keeps one of the rows that repeat a kept document
    # entirely; it uses the join's partitioning and order
    return (docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), some), raw: F.xxhash64("text")})
            .join(kept, [key, raw], "left_semi").dropDuplicates([key, raw]).drop(key, raw))
