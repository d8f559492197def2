"""Repeated byte strings, found in difference-cover suffix arrays.

A window is ``WINDOW`` bytes of one document. Every byte covered by a window
that also starts anywhere else, in the same document or another, goes.

One suffix array of all bytes would shuffle every byte's suffix several times
over. The corpus is dealt by content first, so that equal windows always meet:

1. Rows with equal texts are covered entirely (from ``WINDOW`` bytes on); one
   of them goes on as a reference for the others.
2. A window's anchor is the ``GRAM``-byte run in it with the smallest hash
   (about one position in 85 is one). Equal windows have equal anchors; an
   anchor seen once settles all its windows. Only anchor hashes are shuffled.
3. The text around a repeated anchor (all windows that hold it) is its
   context. A context that occurs twice is covered. Of anchors with different
   contexts, one copy of each context goes to the anchor's shard.
4. A task concatenates the contexts of whole shards and builds their suffix
   array by the difference cover modulo 3: triples at the positions 1 and 2
   modulo 3 are sorted and named, the names are sorted by recursion, the other
   suffixes are sorted by their first byte and the rank behind it, and both
   are merged. Neighbours in the array that agree in ``WINDOW`` bytes are
   repeats; equal windows are always neighbours.
5. An anchor with more than ``MAX_SHARD`` different contexts (the edges of a
   passage in a third of the corpus) has them cut into single windows, which
   are counted by a 128-bit hash, so no shard grows with the corpus.

Null text: no bytes. Repeated rows count as different places. A null doc_id
is returned as it is. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.text import _BYTES, U, _prefix, blocks, mix, range_hash, text_buffer
from basketry.llm.workdir import fresh, saved

WINDOW = 200
GRAM = 32
MAX_SHARD = 2000               # contexts
CHUNK = 1_200_000              # bytes of one suffix array, before its last shard; below 2**21
_NO_ID = (1 << 63) - 1


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of ``s`` (values from 1 to 2**21 - 1, fewer than 2**21)."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate((s, np.zeros(3, s.dtype))).astype(U)
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    b = U(21)
    triple = (t[sample] << U(42)) | (t[sample + 1] << b) | t[sample + 2]
    order = np.argsort(triple, kind="stable")
    ranked = triple[order]
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    if names.max() < len(sample):
        order = suffix_array(names)                       # recurse on the names
    rank = np.zeros(n + 3, U)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    rank[n:] = 0
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]
    # the others: by their first value and the rank of what follows
    zero = np.arange(0, n, 3)
    key = (t[zero] << b) | rank[zero + 1]
    zero = zero[np.argsort(key, kind="stable")]
    # merge: how many sample suffixes come before each of the others
    ones, twos = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    before = np.searchsorted((t[ones] << b) | rank[ones + 1], (t[zero] << b) | rank[zero + 1])
    before = before + np.searchsorted((t[twos] << U(42)) | (t[twos + 1] << b) | rank[twos + 2],
                                      (t[zero] << U(42)) | (t[zero + 1] << b) | rank[zero + 2])
    out = np.empty(n, np.int64)
    place = before + np.arange(len(zero))
    rest = np.ones(n, bool)
    rest[place] = False
    out[place] = zero
    out[rest] = sorted_sample
    return out


def repeated_starts(texts: list[bytes], window: int = WINDOW) -> list[np.ndarray]:
    """For each text the window starts whose window occurs again in ``texts``."""
    sizes = np.array([len(x) for x in texts])
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))           # one separator after each
    n = int(begin[-1])
    s = np.zeros(n, np.int64)
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    s[:] = data
    s += 1
    ends = begin[1:] - 1
    s[ends] = 257 + np.arange(len(texts))                         # all different: no match runs over one
    order = suffix_array(s)
    # eight bytes at every position, for comparing neighbours
    padded = np.concatenate((data, np.zeros(window + 8, np.uint8))).astype(U)
    eight = np.zeros(n + window, U)
    for k in range(8):
        eight = (eight << U(8)) | padded[k:k + n + window]
    left = np.zeros(n + 1, np.int64)
    left[:n] = np.repeat(ends, sizes + 1) - np.arange(n)          # bytes left in the text
    full = left[order] >= window
    near = np.flatnonzero(full[1:] & full[:-1])
    a, b = order[near], order[near + 1]
    steps = [*range(0, window - 7, 8)]
    if window % 8:
        steps.append(window - 8)
    for o in steps if window >= 8 else []:
        same = eight[a + o] == eight[b + o]
        a, b = a[same], b[same]
    if window < 8:
        for o in range(window):
            same = s[a + o] == s[b + o]
            a, b = a[same], b[same]
    hit = np.zeros(n + 1, bool)
    hit[a] = hit[b] = True
    return [np.flatnonzero(hit[x:x + k]) for x, k in zip(begin[:-1].tolist(), sizes.tolist(), strict=True)]


class Anchored:
    """Windows and anchors of a block of texts."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.offsets = offsets - offsets[0]
        self.data = raw[offsets[0]:offsets[-1]]
        n = len(self.data)
        self.prefix = _prefix(self.data.astype(U) + U(1), _BYTES)
        last = np.repeat(self.offsets[1:], np.diff(self.offsets))
        at = np.arange(n)
        self.starts = at[at + WINDOW <= last]
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.offsets))[self.starts]
        m = max(n - GRAM + 1, 0)
        self.grams = range_hash(self.prefix, np.arange(m), np.arange(m) + GRAM, _BYTES)
        # sliding minimum of (hash, position): the leftmost of the smallest
        bits = U(max(n, 1).bit_length())
        low = ((self.grams >> bits) << bits) | np.arange(m, dtype=U)
        width, span = 1, WINDOW - GRAM + 1
        while width * 2 <= span:
            low = np.minimum(low[:-width], low[width:]) if len(low) > width else low[:0]
            width *= 2
        if len(self.starts):
            best = np.minimum(low[self.starts], low[self.starts + span - width])
            self.anchor = (best & ((U(1) << bits) - U(1))).astype(np.int64)
        else:
            self.anchor = np.zeros(0, np.int64)

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first window, number of windows) of each context."""
        head = np.ones(len(self.starts), bool)
        head[1:] = (self.anchor[1:] != self.anchor[:-1]) | (np.diff(self.starts) != 1)
        first = np.flatnonzero(head)
        return first, np.diff(np.append(first, len(self.starts)))


def _summaries(docs: DataFrame) -> DataFrame:
    """doc, text_hash, n_bytes, sha256, anchors (a repeated one twice)."""

    def run(batches):
        for b in batches:
            raw, offsets = text_buffer(b.column(2))
            for lo, hi in blocks(offsets):
                x = Anchored(raw, offsets[lo:hi + 1])
                first, _ = x.runs()
                doc, key = x.doc[first], x.grams[x.anchor[first]]
                order = np.lexsort((key, doc))
                doc, key = doc[order], key[order]
                third = np.zeros(len(key), bool)
                third[2:] = (key[2:] == key[:-2]) & (doc[2:] == doc[:-2])
                doc, key = doc[~third], key[~third]
                cuts = np.searchsorted(doc, np.arange(hi - lo + 1))
                data = x.data.tobytes()
                sums = [hashlib.sha256(data[p:q]).hexdigest() for p, q in zip(x.offsets[:-1].tolist(), x.offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(np.diff(x.offsets)), pa.array(sums, pa.string()),
                     pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(key.view(np.int64)))],
                    ["doc", "text_hash", "n_bytes", "sha256", "anchors"])

    return _keyed(docs).mapInArrow(run, "doc long, text_hash long, n_bytes long, sha256 string, anchors array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"),
                       F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))


def _identity(x: Anchored, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hash of each context's bytes and of the anchor's place in it."""
    start = x.starts[first]
    return mix(range_hash(x.prefix, start, start + count + WINDOW - 1, _BYTES) + (x.anchor[first] - start).astype(U))


def _contexts(texts: DataFrame) -> DataFrame:
    """key, context, doc, text_hash, start, windows of every context of the
    repeated anchors. ``texts``: doc, text_hash, text, shared."""

    def run(batches):
        for b in batches:
            raw, offsets = text_buffer(b.column(2))
            for lo, hi in blocks(offsets):
                x = Anchored(raw, offsets[lo:hi + 1])
                first, count = x.runs()
                doc, key = x.doc[first], x.grams[x.anchor[first]]
                wanted = np.zeros(len(first), bool)
                bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    p, q = bounds[i], bounds[i + 1]
                    wanted[p:q] = np.isin(key[p:q].view(np.int64), b.column(3)[lo + i].values.to_numpy(zero_copy_only=False))
                first, count, doc, key = first[wanted], count[wanted], doc[wanted], key[wanted]
                row = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(_identity(x, first, count).view(np.int64)),
                     b.column(0).take(row), b.column(1).take(row),
                     pa.array(x.starts[first] - x.offsets[doc]), pa.array(count)],
                    ["key", "context", "doc", "text_hash", "start", "windows"])

    return texts.select("doc", "text_hash", "text", "shared").mapInArrow(
        run, "key long, context long, doc long, text_hash long, start long, windows long")


def _bodies(texts: DataFrame, open_: DataFrame) -> DataFrame:
    """key, context, many, body: the bytes of one copy of each open context."""

    def run(batches):
        for b in batches:
            raw, offsets = text_buffer(b.column(0))
            data = raw.tobytes() if len(raw) else b""
            keys, contexts, many, bodies = [], [], [], []
            for i, wanted in enumerate(b.column(1).to_pylist()):
                for w in wanted:
                    at = int(offsets[i]) + w["start"]
                    keys.append(w["key"])
                    contexts.append(w["context"])
                    many.append(w["many"])
                    bodies.append(data[at:at + w["windows"] + WINDOW - 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(contexts, pa.int64()), pa.array(many, pa.bool_()), pa.array(bodies, pa.binary())],
                ["key", "context", "many", "body"])

    wanted = open_.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("key", "context", "start", "windows", "many")).alias("wanted"))
    return (texts.select("doc", "text_hash", "text").dropDuplicates(["doc", "text_hash"]).join(wanted, ["doc", "text_hash"])
            .select("text", "wanted").mapInArrow(run, "key long, context long, many boolean, body binary"))


_FOUND = "key long, context long, runs array<struct<first:long,windows:long>>"


def _sorted_shards(bodies: DataFrame) -> DataFrame:
    """Runs of repeated windows of each context, from its shard's suffix array."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        for starts in repeated_starts([r[2] for r in rows]):
            head = np.flatnonzero(np.concatenate(([True], np.diff(starts) != 1))) if len(starts) else np.zeros(0, int)
            size = np.diff(np.append(head, len(starts)))
            out.append([{"first": f, "windows": w} for f, w in zip(starts[head].tolist(), size.tolist(), strict=True)])
        kind = pa.list_(pa.struct([("first", pa.int64()), ("windows", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                           pa.array(out, kind)], ["key", "context", "runs"])

    def run(batches):
        held: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size >= CHUNK and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2]) + 1
        if held:
            yield solve(held)

    return bodies.repartition("key").sortWithinPartitions("key").select("key", "context", "body").mapInArrow(run, _FOUND)


def _single_windows(bodies: DataFrame) -> DataFrame:
    """The same for anchors with very many contexts, by counting windows."""

    def run(batches):
        for b in batches:
            for key, context, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n = len(body) - WINDOW + 1
                sums = [hashlib.blake2b(body[i:i + WINDOW], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([key] * n), pa.array([context] * n), pa.array(range(n), pa.int64()),
                                                  pa.array(sums, pa.binary())], ["key", "context", "first", "window"])

    windows = saved(bodies.select("key", "context", "body").mapInArrow(run, "key long, context long, first long, window binary"),
                    "suffix-single-windows")
    many = saved(windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window"), "suffix-repeated")
    return (windows.join(many, "window").groupBy("key", "context")
            .agg(F.collect_list(F.struct("first", F.lit(1).cast("long").alias("windows"))).alias("runs")))


def repeated_bytes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summaries with ``copies``; texts of suspects; doc, text_hash, runs of
    window starts that go)."""
    rows = saved(_summaries(docs), "suffix-summaries")
    same = ["sha256", "n_bytes"]
    groups = saved(rows.groupBy(*same).agg(F.min(F.struct("doc", "text_hash")).alias("first"), F.count(F.lit(1)).alias("copies")),
                   "suffix-groups")
    rows = rows.join(groups, same)
    dealt = rows.where("doc = first.doc and text_hash = first.text_hash").select("doc", "text_hash", F.explode("anchors").alias("anchor"))
    shared = saved(dealt.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "suffix-anchors")
    hits = dealt.join(shared, "anchor").groupBy("doc", "text_hash").agg(F.collect_set("anchor").alias("shared"))
    # a row that repeats a doc_id and its text is covered as a copy already
    texts = saved(_keyed(docs).join(hits, ["doc", "text_hash"]).dropDuplicates(["doc", "text_hash"]), "suffix-texts")
    contexts = saved(_contexts(texts), "suffix-contexts")
    one = ["key", "context"]
    distinct = saved(contexts.groupBy(*one).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "text_hash", "start", "windows")).alias("at")),
                     "suffix-distinct")
    shards = saved(distinct.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "suffix-shards")
    open_ = distinct.join(shards, "key").select(*one, "at.*", (F.col("size") > MAX_SHARD).alias("many"))
    bodies = saved(_bodies(texts, open_), "suffix-bodies")
    found = _sorted_shards(bodies.where("not many")).unionByName(_single_windows(bodies.where("many")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("at.windows").alias("windows")))
    decided = saved(distinct.join(found, one, "left").select(
        *one, F.when(F.col("n") > 1, whole).otherwise(F.col("runs")).alias("runs")).where("size(runs) > 0"), "suffix-decided")
    gone = (contexts.join(decided, one)
            .select("doc", "text_hash", F.expr("transform(runs, r -> struct(r.first + start as first, r.windows as windows))").alias("runs"))
            .groupBy("doc", "text_hash").agg(F.flatten(F.collect_list("runs")).alias("runs")))
    return rows, texts, gone


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_bytes, n_removed, n_spans, spans (array of [start,
    end) byte ranges; null: the whole text), kept (binary; null if nothing
    goes or all), kept_sha256."""
    rows, texts, gone = repeated_bytes(docs)

    def cut(batches):
        for b in batches:
            raw, offsets = text_buffer(b.column(2))
            removed, spans, kept, sums = [], [], [], []
            for i, runs in enumerate(b.column(3)):
                data = raw[offsets[i]:offsets[i + 1]]
                first = runs.values.field("first").to_numpy(zero_copy_only=False)
                size = runs.values.field("windows").to_numpy(zero_copy_only=False)
                mark = np.zeros(len(data) + 1, np.int64)
                np.add.at(mark, first, 1)
                np.add.at(mark, first + size + WINDOW - 1, -1)
                out = np.concatenate(([False], np.cumsum(mark)[:-1] > 0, [False]))
                spans.append(np.flatnonzero(out[1:] != out[:-1]).reshape(-1, 2).tolist())
                body = data[~out[1:-1]].tobytes()
                removed.append(len(data) - len(body))
                kept.append(body)
                sums.append(hashlib.sha256(body).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                 pa.array(kept, pa.binary()), pa.array(sums, pa.string())],
                ["doc", "text_hash", "cut_bytes", "spans", "kept", "cut_sha256"])

    cuts = (texts.select("doc", "text_hash", "text").join(gone, ["doc", "text_hash"]).select("doc", "text_hash", "text", "runs")
            .mapInArrow(cut, "doc long, text_hash long, cut_bytes long, spans array<array<long>>, kept binary, cut_sha256 string"))
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= WINDOW)
    empty = hashlib.sha256(b"").hexdigest()
    return (rows.select("doc", "text_hash", "n_bytes", "sha256", "copies").join(cuts, ["doc", "text_hash"], "left")
            .select(F.when(F.col("doc") < _NO_ID, F.col("doc")).alias("doc_id"), "text_hash", "n_bytes",
                    F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("cut_bytes", F.lit(0))).cast("long").alias("n_removed"),
                    F.when(whole, F.lit(1)).otherwise(F.coalesce(F.size("spans"), F.lit(0))).cast("long").alias("n_spans"),
                    F.when(~whole, F.coalesce("spans", F.array().cast("array<array<long>>"))).alias("spans"),
                    F.when(~whole, F.col("kept")).alias("kept"),
                    F.when(whole, F.lit(empty)).otherwise(F.coalesce("cut_sha256", "sha256")).alias("kept_sha256")))


def drop_repeated_bytes(docs: DataFrame) -> DataFrame:
    """``docs`` (all columns) with ``kept_bytes``: the text's UTF-8 bytes
    without the repeated strings (a cut may fall inside a character)."""
    key, th, body, n, kept = fresh(docs, "_key", "_th", "_kept", "_n", "kept_bytes")
    changed = (suffix_dedup(docs).where("n_removed > 0")
               .select(F.coalesce("doc_id", F.lit(_NO_ID)).alias(key), F.col("text_hash").alias(th),
                       F.coalesce("kept", F.lit(b"")).alias(body), F.lit(1).alias(n)).dropDuplicates([key, th]))
    joined = (docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), th: F.xxhash64("text")})
              .join(changed, [key, th], "left"))
    plain = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    return joined.select(*docs.columns, F.when(F.col(n).isNotNull(), F.col(body)).otherwise(plain).alias(kept))
