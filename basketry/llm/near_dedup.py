"""Near-duplicate detection with HyperMinHash sketches.

1. Every whole text becomes the set of hashes of its distinct word shingles.
   Texts with equal sets form a class, represented by its smallest doc_id.
2. A HyperMinHash sketch has ``REGISTERS`` buckets; a bucket keeps, of the
   smallest hash that fell into it, the count of leading zeros (6 bits) and
   the next 10 mantissa bits. A bucket that stays empty borrows from another
   one that a fixed random sequence names, so small sets can be compared too.
3. Bands of ``BAND`` registers are hashed; classes that share a band hash are
   candidates. At Jaccard 0.8 all 40 bands of 5 miss with probability 1e-7.
4. Candidates are first tried against one centre for each band bucket (a star,
   not all pairs): the class that shares the most buckets with others, which
   in a group of copies is the text nearest to all. Pairs pass an estimate and
   are then compared on their full sets. Linked classes form components; only
   bucket neighbours of different components are still compared with each
   other, once, in the first band that they share, and only if their rarest
   shingles leave the threshold within reach (an exact bound: copies with many
   changes of their own drop out). A large group of copies so costs about one
   comparison for each member and bucket.
5. The estimate counts agreeing registers and corrects for accidental
   agreement. Pairs of larger sets whose estimate is more than 5 standard
   errors below the threshold are not counted; where borrowed registers make
   the error larger (sets under ``EXACT_BELOW``), every pair is. A cheaper form
   of it, on one bit of each register, already filters the bucket join, with a
   margin that grows as sets get smaller. Every link is confirmed on the full
   sets.

Words are runs without ASCII white space, A-Z lower-cased; a text of fewer
words than a shingle is one shingle; texts without words are linked with
nothing. Null text counts as empty; rows with a null doc_id are linked with
nothing and keep themselves; rows sharing a doc_id are one node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.components import components
from basketry.llm.text import Words, blocks, mix, text_buffer
from basketry.llm.workdir import fresh, saved

SHINGLE_WORDS = 2
THRESHOLD = 80               # per cent
BAND = 5
BANDS = 40
REGISTERS = BAND * BANDS
MANTISSA_BITS = 10
# a pair this far below the threshold is not verified: over five standard
# errors (0.028 at 0.8) of the estimate from whole registers, which holds from
# EXACT_BELOW shingles on, and over four of the one from a bit each
# (BIT_MARGIN + BIT_SMALL / sqrt(n), n: the smaller set's size)
MARGIN = 0.16
EXACT_BELOW = 512
BIT_MARGIN, BIT_SMALL = 0.19, 0.8
_BIT_WORDS = -(-REGISTERS // 64)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, first of each text + end,
    words of each text)."""
    w = Words(raw, offsets, lower=True)
    n = len(w.counts)
    hashes = w.hashes()
    at, shingles = w.windows(hashes, words)
    doc = w.doc()[at]
    few = np.flatnonzero((w.counts > 0) & (w.counts < words))
    if len(few):
        # the whole sequence as one shingle: its words and their number
        whole = [mix(np.bitwise_xor.reduce(mix(hashes[w.first[i]:w.first[i + 1]] * np.uint64(3)
                                               + np.arange(w.counts[i], dtype=np.uint64)), keepdims=True))[0] for i in few]
        doc, shingles = np.concatenate((doc, few)), np.concatenate((shingles, np.array(whole, np.uint64)))
    order = np.lexsort((shingles, doc))
    doc, shingles = doc[order], shingles[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (shingles[1:] != shingles[:-1])
    doc, shingles = doc[new], shingles[new]
    return shingles, np.searchsorted(doc, np.arange(n + 1)), w.counts


def set_keys(shingles: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Each set's identity: two independent sums over its members."""
    seed = np.uint64(0x5851F42D4C957F2D)
    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(shingles ^ s)))) for s in (seed, ~seed)]
    return [(s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums]


def _borrow_order() -> np.ndarray:
    rng = np.random.default_rng(20)
    return np.stack([rng.permutation(REGISTERS) for _ in range(REGISTERS)])


_ORDER = _borrow_order()


def sketches(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16) of each set; empty sets get zeros."""
    docs = len(first) - 1
    sizes = np.diff(first)
    doc = np.repeat(np.arange(docs), sizes)
    bucket = (mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(REGISTERS)).astype(np.int64)
    cell = doc * REGISTERS + bucket
    least = np.full(docs * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, cell, shingles)
    full = np.zeros(docs * REGISTERS, bool)
    full[cell] = True
    least, full = least.reshape(docs, REGISTERS), full.reshape(docs, REGISTERS)
    # leading zeros of the 64-bit minimum, then the mantissa after its first 1
    value = np.maximum(least, np.uint64(1))
    exponent = 63 - _top_bit(value)
    shifted = value << exponent.astype(np.uint64)                     # first 1 at the top
    mantissa = (shifted << np.uint64(1)) >> np.uint64(64 - MANTISSA_BITS)
    registers = ((exponent.astype(np.uint64) << np.uint64(MANTISSA_BITS)) | mantissa).astype(np.uint16)
    row, empty = np.nonzero(~full & full.any(axis=1)[:, None])
    source = registers.copy()
    for turn in range(REGISTERS):
        if not len(row):
            break
        lender = _ORDER[empty, turn]
        ok = full[row, lender]
        registers[row[ok], empty[ok]] = source[row[ok], lender[ok]]
        row, empty = row[~ok], empty[~ok]
    registers[~full.any(axis=1)] = 0
    return registers


def _top_bit(x: np.ndarray) -> np.ndarray:
    """Position of the highest 1 bit."""
    out = np.zeros(x.shape, np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        big = x >> np.uint64(step) != 0
        out += step * big
        x = np.where(big, x >> np.uint64(step), x)
    return out


def band_hashes(registers: np.ndarray) -> np.ndarray:
    """(sets, BANDS) hashes of the bands' registers and their number."""
    parts = registers.reshape(len(registers), BANDS, BAND).astype(np.uint64)
    total = np.zeros(parts.shape[:2], np.uint64)
    for k in range(BAND):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k] + np.uint64(1))
    return mix(total + np.arange(BANDS, dtype=np.uint64))


def one_bit(registers: np.ndarray) -> np.ndarray:
    """The lowest mantissa bit of every register, in 64-bit words."""
    bits = np.zeros((len(registers), _BIT_WORDS * 64), np.uint8)
    bits[:, :REGISTERS] = registers & 1
    return np.packbits(bits, axis=1).view(np.int64).reshape(len(registers), _BIT_WORDS)


def _sketch_rows(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_key, bands, bits of every row."""
    def run(batches):
        for b in batches:
            raw, offsets = text_buffer(b.column(1))
            for lo, hi in blocks(offsets):
                shingles, first, _ = shingle_sets(raw, offsets[lo:hi + 1], words)
                size = np.diff(first)
                keys = set_keys(shingles, first)
                registers = sketches(shingles, first)
                bands = band_hashes(registers).view(np.int64).ravel()
                bits = one_bit(registers).ravel()
                n = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, n), pa.array(size), pa.array(keys[0]), pa.array(keys[1]),
                     pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands)),
                     pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * _BIT_WORDS), pa.array(bits))],
                    ["doc_id", "n_shingles", "key1", "key2", "bands", "bits"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>, bits array<long>"))


def _plausible(n1: Column, n2: Column, bits1: Column, bits2: Column, threshold: int) -> Column:
    """Sizes that allow the threshold, and an estimate near it: registers that
    differ agree in one bit half of the time, so J = 1 - 2 * (share of
    differing bits)."""
    differing = sum((F.bit_count(bits1[k].bitwiseXOR(bits2[k])) for k in range(_BIT_WORDS)), F.lit(0))
    margin = F.lit(BIT_MARGIN) + F.lit(BIT_SMALL) / F.sqrt(F.least(n1, n2))
    most = (F.lit(1 - threshold / 100) + margin) * F.lit(REGISTERS / 2)
    return ((F.least(n1, n2) * 100 >= F.greatest(n1, n2) * threshold) & (differing <= most))


def _rare_parts(texts: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """class, key1, rare, last: the rarest quarter of each set's shingles
    (rarity: how many of ``classes`` have it) and the order of its last one.

    Two sets share at most the shingles in both rare parts, and what is left
    of the set whose rare part ends first: an exact bound on the Jaccard."""

    def run(batches):
        for b in batches:
            raw, offsets = text_buffer(b.column(1))
            for lo, hi in blocks(offsets):
                shingles, first, _ = shingle_sets(raw, offsets[lo:hi + 1], words)
                size = np.diff(first)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(np.repeat(np.arange(lo, hi), size))), pa.array(np.repeat(set_keys(shingles, first)[0], size)),
                     pa.array(shingles.view(np.int64))], ["class", "key1", "shingle"])

    members = saved(texts.join(classes.withColumnRenamed("class", "_id"), "_id", "left_semi")
                    .mapInArrow(run, "class long, key1 long, shingle long"), "near-open-sets")
    counts = saved(members.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")), "near-shingle-counts")
    ordered = F.sort_array(F.collect_set(F.struct("df", "shingle")))
    return (members.join(counts, "shingle").groupBy("class", "key1").agg(ordered.alias("s"))
            .select("class", "key1", F.slice("s", 1, F.ceil(F.size("s") / 4).cast("int")).alias("s"))
            .select("class", "key1", F.col("s.shingle").alias("rare"), F.element_at("s", -1).alias("last")))


def _verified(candidates: DataFrame, texts: DataFrame, words: int, threshold: int) -> DataFrame:
    """The pairs (a, b) of doc_ids whose full sets meet the threshold.
    ``texts``: _id, text."""
    pairs = saved(candidates.select("a", "b").distinct(), "near-candidates")
    wanted = pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct()

    def sets(batches):
        for b in batches:
            raw, offsets = text_buffer(b.column(1))
            for lo, hi in blocks(offsets):
                shingles, first, _ = shingle_sets(raw, offsets[lo:hi + 1], words)
                registers = sketches(shingles, first)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array([shingles[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)], pa.binary()),
                     pa.array([r.tobytes() for r in registers], pa.binary())], ["id", "members", "sketch"])

    # a class representative's rows have equal sets if they share a doc_id
    found = saved(texts.join(wanted, "_id", "left_semi").mapInArrow(sets, "id long, members binary, sketch binary"), "near-sets")

    def confirm(batches):
        for b in batches:
            keep = [_linked(*(x.as_py() for x in row), threshold) for row in zip(*b.columns[2:6], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keep, pa.bool_())], ["a", "b", "ok"])

    left = found.select(F.col("id").alias("a"), F.col("members").alias("m1"), F.col("sketch").alias("s1"))
    right = found.select(F.col("id").alias("b"), F.col("members").alias("m2"), F.col("sketch").alias("s2"))
    return (pairs.join(left, "a").join(right, "b").select("a", "b", "m1", "m2", "s1", "s2")
            .mapInArrow(confirm, "a long, b long, ok boolean").where("ok").select("a", "b"))


def estimate(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard from two sketches' registers, corrected for accidental
    agreement: registers with equal leading zeros agree by chance in the
    mantissa, at most once in 2**MANTISSA_BITS and by exponent 1/3."""
    agree = np.count_nonzero(x == y) / len(x)
    chance = 2.0 ** -MANTISSA_BITS / 3
    return (agree - chance) / (1 - chance)


def _linked(m1: bytes, m2: bytes, s1: bytes, s2: bytes, threshold: int) -> bool:
    x, y = np.frombuffer(m1, np.uint64), np.frombuffer(m2, np.uint64)
    if (min(len(x), len(y)) >= EXACT_BELOW
            and estimate(np.frombuffer(s1, np.uint16), np.frombuffer(s2, np.uint16)) < threshold / 100 - MARGIN):
        return False
    both = np.concatenate((x, y))
    both.sort(kind="mergesort")
    inter = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * inter >= threshold * (len(both) - inter)


def near_groups(docs: DataFrame, words: int = SHINGLE_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``."""
    rows = saved(_sketch_rows(docs, words), "near-sketches")
    usable = rows.where("n_shingles > 0 and doc_id is not null")
    keys = ["n_shingles", "key1", "key2"]
    # Tables that hot rows are joined with are written first: with plain scans
    # on both sides Spark can split a hot key's partition.
    classes = saved(usable.groupBy(*keys).agg(F.min("doc_id").alias("class")), "near-keys")
    heads = saved(usable.join(classes.withColumnRenamed("class", "doc_id"), [*keys, "doc_id"], "left_semi")
                  .dropDuplicates(["doc_id", *keys])
                  .select(F.col("doc_id").alias("class"), "n_shingles", "key1", "bits", "bands"), "near-classes")

    # (band hash, class) of all buckets of two classes or more, with the
    # bucket's centre
    dealt = heads.select("class", F.explode("bands").alias("band"))
    shared = saved(dealt.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-shared")
    dealt = saved(dealt.join(shared, "band"), "near-dealt")
    scores = dealt.groupBy("class").agg(F.sum("n").alias("score"))
    centres = saved(dealt.join(scores, "class").groupBy("band").agg(F.max(F.struct("score", (-F.col("class")).alias("_c"))).alias("best"))
                    .select("band", (-F.col("best._c")).alias("centre")), "near-centres")
    buckets = saved(dealt.select("band", "class").join(centres, "band"), "near-buckets")
    info = heads.select("class", "n_shingles", "bits")
    # only texts that share a bucket are looked at again
    texts = saved(docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
                  .join(buckets.select(F.col("class").alias("_id")).distinct(), "_id", "left_semi"), "near-texts")

    def with_info(pairs: DataFrame) -> DataFrame:
        one = info.select(F.col("class").alias("a"), F.col("n_shingles").alias("n1"), F.col("bits").alias("bits1"))
        two = info.select(F.col("class").alias("b"), F.col("n_shingles").alias("n2"), F.col("bits").alias("bits2"))
        return pairs.join(one, "a").join(two, "b").where(
            _plausible(F.col("n1"), F.col("n2"), F.col("bits1"), F.col("bits2"), threshold))

    stars = (buckets.where("centre <> class").select(F.col("centre").alias("a"), F.col("class").alias("b")).distinct())
    links = _verified(with_info(stars), texts, words, threshold)
    labels = components(links)

    # members of one bucket that the stars left in different components
    members = saved(buckets.join(labels, buckets["class"] == labels["node"], "left")
                    .select("band", "class", F.coalesce("component", "class").alias("component")), "near-members")
    mixed = saved(members.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"))
                  .where("x < y").select("band"), "near-mixed")
    members = saved(members.join(mixed, "band"), "near-mixed-members")
    rare = _rare_parts(texts, members.select("class").distinct(), words)
    open_ = saved(members.join(heads, "class").join(rare, ["class", "key1"])
                  .select("band", "class", "component", "n_shingles", "bits", "bands", "rare", "last"), "near-open")
    p, q = open_.alias("p"), open_.alias("q")
    # shared shingles: in both rare parts, or behind the one that ends first
    left_over = F.when(F.col("p.last") <= F.col("q.last"), F.col("p.n_shingles") - F.size("p.rare")).otherwise(
        F.col("q.n_shingles") - F.size("q.rare"))
    within = ((F.size(F.array_intersect("p.rare", "q.rare")) + left_over) * (100 + threshold)
              >= (F.col("p.n_shingles") + F.col("q.n_shingles")) * threshold)
    first_band = F.filter(F.zip_with("p.bands", "q.bands", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())[0]
    cross = (p.join(q, (F.col("p.band") == F.col("q.band")) & (F.col("p.component") < F.col("q.component"))
                    & _plausible(F.col("p.n_shingles"), F.col("q.n_shingles"), F.col("p.bits"), F.col("q.bits"), threshold)
                    & (F.col("p.band") == first_band) & within)
             .select(F.least("p.class", "q.class").alias("a"), F.greatest("p.class", "q.class").alias("b")))
    more = _verified(cross, texts, words, threshold)
    joined = components(more.union(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    named = saved(classes.join(joined, classes["class"] == joined["node"], "left").select(
        *keys, F.coalesce("component", "class").alias("component")), "near-named")
    out = rows.select("doc_id", *keys).join(named, keys, "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` (all columns) with one document of each group."""
    key, = fresh(docs, "_key")
    gone = near_groups(docs, words, threshold).where("not kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.withColumn(key, F.col("doc_id").cast("long")).join(gone, key, "left_anti").drop(key)
