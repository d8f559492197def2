"""Sharding by a Feistel permutation over global row numbers.

Rows get dense global numbers in the order of (doc_id, text): a distributed
range sort whose partition sizes are prefix-summed. A Feistel network, keyed
by the seed, permutes the numbers: it works on 2b bits, the least that hold
them, and a value beyond the row count is encrypted again until it falls
inside (cycle walking), which keeps it a permutation of exactly 0..n-1. With
place = permuted number, shard = place mod shards and slot = place div shards:
shard sizes differ by one at most, slots have no gaps, and both can be
computed from the number alone, as ``place_of`` and ``row_of`` do, with no
table to look them up in.

Equal texts are not kept together: the law held is ``rows``, and a group of
copies may be larger than a shard. Null text: no bytes; null doc_id sorts
first; fully repeated rows take neighbouring numbers; an empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.text import mix
from basketry.llm.workdir import fresh
from basketry.operators.ranking import global_rank

SHARDS = 8
SEED = 0x5EED
ROUNDS = 6


class FeistelPermutation:
    """Permutation of range(n), computable for any single number."""

    def __init__(self, n: int, seed: int = SEED, rounds: int = ROUNDS):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) + mix(np.array([seed], np.uint64)))

    def _network(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & self.mask)
        return (left << np.uint64(self.half)) | right

    def _inverse(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in self.keys[::-1]:
            left, right = right ^ (mix(left + k) & self.mask), left
        return (left << np.uint64(self.half)) | right

    def _walk(self, x, step) -> np.ndarray:
        out = step(np.asarray(x).astype(np.uint64))
        outside = np.flatnonzero(out >= np.uint64(self.n))
        while len(outside):            # the domain is under 4n: each turn leaves less than 3/4
            out[outside] = step(out[outside])
            outside = outside[out[outside] >= np.uint64(self.n)]
        return out.astype(np.int64)

    def place_of(self, row) -> np.ndarray:
        return self._walk(row, lambda x: self._network(x, self.keys))

    def row_of(self, place) -> np.ndarray:
        return self._walk(place, self._inverse)


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``docs``' doc_id, size (UTF-8 bytes and 1 more), text_crc32, with
    row_number, shard and slot."""

    def permute(batches):
        walk = None
        for b in batches:
            if not b.num_rows:
                continue
            if walk is None:
                walk = FeistelPermutation(b.column(4)[0].as_py(), seed)
            place = walk.place_of(b.column(3).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array((place % shards).astype(np.int32)), pa.array(place // shards)],
                ["doc_id", "size", "text_crc32", "row_number", "shard", "slot"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       (F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))) + 1).cast("long").alias("size"),
                       F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
                       F.xxhash64("text").alias("_hash"))
    numbered = global_rank(rows, [F.col("doc_id").asc_nulls_first()], ["text_crc32", "size", "_hash"],
                           rank="_row", total="_rows")
    return (numbered.select("doc_id", "size", "text_crc32", "_row", "_rows")
            .mapInArrow(permute, "doc_id long, size long, text_crc32 long, row_number long, shard int, slot long"))


def in_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``docs`` (all columns) with ``shard`` and ``slot``, for
    ``write.partitionBy("shard")``. Rows that repeat doc_id and text take the
    places that ``shard_rows`` gives them, in any order among themselves."""
    key, th, nth, shard, slot = fresh(docs, "_key", "_th", "_nth", "shard", "slot")
    none = F.lit(-(1 << 63))
    crc = F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    places = shard_rows(docs, shards, seed).select(
        F.coalesce("doc_id", none).alias(key), F.col("text_crc32").alias(th), "row_number",
        F.col("shard").alias(shard), F.col("slot").alias(slot))
    places = places.withColumn(nth, F.row_number().over(Window.partitionBy(key, th).orderBy("row_number")))
    rows = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), none), th: crc})
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(key, th).orderBy(F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.xxhash64("text"))))
    return rows.join(places, [key, th, nth]).select(*docs.columns, shard, slot)
