"""Line deduplication over range-partitioned line hashes.

Every line's key (stripped of ASCII white space, A-Z lower-cased) is hashed to
128 bits. The rows (hash, document, position) are range-partitioned and sorted
by all three, so a line found in a third of all documents is spread over many
tasks by its document ids. Each task then streams its rows once and marks all
but the first document of a hash. A hash that starts in an earlier partition
has its first document there: every partition reports its first and last hash
(one row a partition), and that table, bounded by the number of partitions,
is handed to the streaming pass. The sorted rows are checkpointed in the
shared folder in between, as range bounds come from a sample and both passes
must see the same partitions.

What leaves the operator is one zlib-compressed keep bitmap per changed
document; texts are touched only when ``apply_keep_bitmaps`` is called.

Null or empty text: one empty line. Null doc_id: counts as the largest id.
Rows that share a doc_id are one document, each text with a bitmap of its own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.text import LOWER, SEPARATORS, text_buffer
from basketry.llm.workdir import fresh, saved
from basketry.session import ensure_checkpoint_dir

MIN_KEY_CHARS = 10
_NO_ID = (1 << 63) - 1
_LOWER = LOWER.tobytes()
_CONTINUATION = bytes(range(0x80, 0xC0))


def line_key(line: bytes) -> bytes:
    return line.strip(SEPARATORS).translate(_LOWER)


def _line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """hash, doc, text_hash, pos of every line whose key is long enough."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            texts = b.column(1).to_numpy(zero_copy_only=False)
            raw, offsets = text_buffer(b.column(2))
            hashes, row, pos = [], [], []
            for i in range(len(ids)):
                for p, line in enumerate(raw[offsets[i]:offsets[i + 1]].tobytes().split(b"\n")):
                    key = line_key(line)
                    if len(key) >= min_chars and len(key.translate(None, _CONTINUATION)) >= min_chars:
                        hashes.append(xxhash.xxh3_128_digest(key))
                        row.append(i)
                        pos.append(p)
            row = np.array(row, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes, pa.binary()), pa.array(ids[row]), pa.array(texts[row]),
                 pa.array(np.array(pos, np.int32))], ["hash", "doc", "text_hash", "pos"])

    return (docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), F.xxhash64("text"),
                        F.col("text").cast("string"))
            .mapInArrow(run, "hash binary, doc long, text_hash long, pos int"))


def _runs(hashes: pa.Array) -> np.ndarray:
    """True where a new hash starts (the first row of a batch included)."""
    wide = np.frombuffer(hashes.buffers()[2], np.uint64)
    lo = np.frombuffer(hashes.buffers()[1], np.int32)[hashes.offset] // 8
    wide = wide[lo:lo + 2 * len(hashes)].reshape(-1, 2)
    new = np.ones(len(hashes), bool)
    new[1:] = (wide[1:] != wide[:-1]).any(axis=1)
    return new


def dropped_lines(docs: DataFrame, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """doc, text_hash, pos of every line that goes."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    keys = ["hash", "doc", "text_hash", "pos"]
    # saved first: drawing the range bounds reads all rows once more
    placed = (saved(_line_rows(docs, min_chars), "line-hashes").repartitionByRange(*keys).sortWithinPartitions(*keys)
              .withColumn("part", F.spark_partition_id()).checkpoint(eager=True))

    def edges(batches):
        first = last = owner = part = None
        for b in batches:
            if not b.num_rows:
                continue
            new = np.flatnonzero(_runs(b.column(0)))
            tail = b.column(0)[int(new[-1])].as_py()
            if first is None:
                first, part = b.column(0)[0].as_py(), b.column(2)[0].as_py()
            if tail != last:
                last, owner = tail, b.column(1)[int(new[-1])].as_py()
        if first is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "first": pa.array([first], pa.binary()),
                                              "last": pa.array([last], pa.binary()), "owner": pa.array([owner], pa.int64())})

    # one row per range partition
    ends = placed.select("hash", "doc", "part").mapInArrow(edges, "part int, first binary, last binary, owner long").collect()
    carried: dict[int, tuple[bytes, int]] = {}
    owner_of: dict[bytes, int] = {}
    for e in sorted(ends, key=lambda e: e["part"]):
        if bytes(e["first"]) in owner_of:
            carried[e["part"]] = (bytes(e["first"]), owner_of[bytes(e["first"])])
        last = bytes(e["last"])
        owner_of = {last: owner_of.get(last, e["owner"])}

    def stream(batches):
        last, owner = None, None
        for b in batches:
            if not b.num_rows:
                continue
            if last is None:
                last, owner = carried.get(b.column(4)[0].as_py(), (b"", None))
            new = _runs(b.column(0))
            docs_ = b.column(1).to_numpy(zero_copy_only=False)
            if b.column(0)[0].as_py() == last:
                new[0] = False
            starts = np.flatnonzero(new)
            # the owner carried in, then the first document of each run
            owners = np.concatenate(([owner if owner is not None else 0], docs_[starts]))[np.cumsum(new)]
            last, owner = b.column(0)[len(docs_) - 1].as_py(), int(owners[-1])
            gone = np.flatnonzero(docs_ != owners)
            yield pa.RecordBatch.from_arrays([b.column(k).take(pa.array(gone)) for k in (1, 2, 3)],
                                             ["doc", "text_hash", "pos"])

    return (placed.select("hash", "doc", "text_hash", "pos", "part")
            .mapInArrow(stream, "doc long, text_hash long, pos int"))


def line_keep_bitmaps(docs: DataFrame, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """doc, text_hash, n_dropped, last, keep_bitmap: one row for each text that
    loses a line. ``keep_bitmap`` is a zlib-compressed bit string, 1 for a line
    that stays; lines beyond it stay."""

    def pack(batches):
        for b in batches:
            maps, sizes = [], []
            for pos in b.column(2).to_pylist():
                keep = np.ones(max(pos) // 8 * 8 + 8, bool)      # whole bytes
                keep[pos] = False
                maps.append(zlib.compress(np.packbits(keep).tobytes()))
                sizes.append(int((~keep).sum()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(maps, pa.binary())],
                ["doc", "text_hash", "n_dropped", "keep_bitmap"])

    return (dropped_lines(docs, min_chars).groupBy("doc", "text_hash").agg(F.collect_set("pos").alias("pos"))
            .mapInArrow(pack, "doc long, text_hash long, n_dropped long, keep_bitmap binary"))


def apply_keep_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the lines cut that ``bitmaps`` drops, plus ``n_lines``
    (before) and ``n_dropped``."""
    key, th, lines, dropped, keep, body = fresh(docs, "_doc", "_th", "n_lines", "n_dropped", "_keep", "_body")

    @F.pandas_udf("string")
    def cut(text, bitmap):
        out = []
        for t, b in zip(text, bitmap, strict=True):
            if b is not None:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(b), np.uint8))
                t = "\n".join([x for k, x in enumerate(t.split("\n")) if k >= len(bits) or bits[k]])
            out.append(t)
        return type(text)(out, dtype=object)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = (docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), th: F.xxhash64("text")})
              .join(bitmaps.select(F.col("doc").alias(key), F.col("text_hash").alias(th),
                                   F.col("n_dropped").alias(dropped), F.col("keep_bitmap").alias(keep)),
                    [key, th], "left"))
    return joined.withColumns({
        lines: (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.lit(1)).cast("long"),
        dropped: F.coalesce(dropped, F.lit(0).cast("long")), body: cut(text, F.col(keep)),
    }).select(*[F.col(body).alias("text") if c == "text" else F.col(c) for c in docs.columns], lines, dropped)


def line_dedup(docs: DataFrame, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """``docs`` without repeated lines, plus ``n_lines`` and ``n_dropped``."""
    return apply_keep_bitmaps(docs, line_keep_bitmaps(docs, min_chars))
