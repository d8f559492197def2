"""Repeated passages of words, found with suffix automata.

A window is ``WINDOW`` consecutive words of one document. Every word covered
by a window whose words also start in a document with a smaller doc_id goes.

Streaming every document through the automaton of every reference shard costs
documents x shards. Here a shard's automaton meets only the passages that can
match in it:

1. Documents with equal word sequences are represented by the smallest id; the
   others are covered entirely.
2. Each window has an anchor: the ``GRAM``-word run in it with the smallest
   hash. Equal windows have equal anchors, so a window can repeat only if its
   anchor occurs in two documents. About a fifth of all positions are anchors;
   only their hashes are shuffled to find the shared ones.
3. The text around a shared anchor (all windows that hold it) is its context.
   Equal contexts are merged on the map side, keeping the smallest doc_id.
   The different contexts of one anchor form a reference shard (their words
   are read once, from the smallest document): their generalised suffix
   automaton knows for every state the smallest doc_id that reaches it, and
   each context is streamed through it for its matching statistics. A match of
   13 words names the smallest document that holds the window.
4. An anchor in more than ``MAX_SHARD`` documents (a passage in a third of the
   corpus) has its contexts cut into single windows, which are shards of their
   own. An anchor in fewer documents can still have more different contexts (a
   phrase that long documents repeat with changing surroundings): these are
   cut into windows, too, and merged by equality, so that no automaton holds
   more than ``MAX_SHARD`` contexts (of at most 21 words).

Words are compared by 48-bit hashes inside contexts that share an anchor of
five words. Null text: no words; a null doc_id counts as the largest; rows
that share a doc_id are one document. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.text import Words, blocks, mix, text_buffer
from basketry.llm.workdir import fresh, saved

WINDOW = 13
GRAM = 5
MAX_SHARD = 2000
MAX_BROADCAST_COPIES = 1_000_000
MARK_BITS = 1 << 27          # 16 MB
BLOCK = 1 << 18              # bytes of text worked on at once: a word of it may stand in many windows
_NO_ID = (1 << 63) - 1
_REACH = WINDOW - GRAM


class SuffixAutomaton:
    """Generalised suffix automaton; each state keeps the smallest owner of
    the strings that reach it."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.owner = [-1], [0], [_NO_ID]

    def _state(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.owner.append(_NO_ID)
        return len(self.next) - 1

    def _split(self, p: int, c, q: int) -> int:
        """A copy of q for the strings that end at p + c."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words, owner: int) -> None:
        last = 0
        for c in words:
            p, q = last, self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
            else:
                last = self._state(self.length[p] + 1, {}, 0)
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = last
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][c]
                    self.link[last] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
            self.owner[last] = min(self.owner[last], owner)

    def finish(self) -> None:
        """Owners of a state hold for all its suffixes, too."""
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            u = self.link[v]
            if self.owner[v] < self.owner[u]:
                self.owner[u] = self.owner[v]

    def owners(self, words, window: int) -> list[int]:
        """Smallest owner of each run of ``window`` words (``_NO_ID``: none)."""
        out, state, matched = [], 0, 0
        for k, c in enumerate(words):
            while state and c not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                matched += 1
            while self.length[self.link[state]] >= window:      # the state of the last `window` words
                state = self.link[state]
                matched = self.length[state]
            if k >= window - 1:
                out.append(self.owner[state] if matched >= window else _NO_ID)
        return out


def anchors(w: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of every window, word index of its anchor, anchor hash by word)."""
    at, grams = w.windows(hashes, GRAM)
    by_word = np.full(len(hashes) + WINDOW, np.iinfo(np.uint64).max, np.uint64)
    by_word[at] = grams
    starts = w.window_starts(WINDOW)
    best = starts + _REACH
    value = by_word[best]
    for o in range(_REACH - 1, -1, -1):        # leftmost of the smallest
        v = by_word[starts + o]
        better = v <= value
        best = np.where(better, starts + o, best)
        value = np.where(better, v, value)
    return starts, best, by_word


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"),
                       F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))


def _summaries(docs: DataFrame) -> DataFrame:
    """doc, text_hash, n_words and the sha256 of the words joined by a space."""

    def run(batches):
        for b in batches:
            raw, offsets = text_buffer(b.column(2))
            sizes, sums = [], []
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                words = raw[lo:hi].tobytes().split()        # parts bytes at the same six characters
                sizes.append(len(words))
                sums.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(sums, pa.string())],
                                             ["doc", "text_hash", "n_words", "words_sha256"])

    return _keyed(docs).mapInArrow(run, "doc long, text_hash long, n_words long, words_sha256 string")


def _row_key(doc: Column, text_hash: Column) -> Column:
    """A number for each (doc, text), near the doc_id so that it compresses;
    rows of one doc_id (or of none) are spread. Rows that share a number only
    share each other's anchors, which costs work and changes no result."""
    return F.shiftleft(F.when(doc < _NO_ID, doc).otherwise(F.lit(-1)), 10).bitwiseOR(F.pmod(text_hash, F.lit(1024)))


def _anchor_rows(texts: DataFrame) -> DataFrame:
    """doc, anchor: the distinct anchor hashes of each row of ``texts``; doc is
    the row's ``_row_key``."""

    def run(batches):
        for b in batches:
            raw, offsets = text_buffer(b.column(1))
            for lo, hi in blocks(offsets, BLOCK):
                w = Words(raw, offsets[lo:hi + 1])
                _, best, by_word = anchors(w, w.hashes())
                at = best[np.concatenate(([True], best[1:] != best[:-1]))] if len(best) else best
                doc, key = w.doc()[at], by_word[at]
                order = np.lexsort((key, doc))
                doc, key = doc[order], key[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc[new] + lo)), pa.array(key[new].view(np.int64))],
                                                 ["doc", "anchor"])

    return texts.select(_row_key(F.col("doc"), F.col("text_hash")), "text").mapInArrow(run, "doc long, anchor long")


def _marked(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose (doc, text_hash) may be in ``wanted``, so
    that the join with it shuffles few others: a bit for each hash, in bitmaps
    of at most ``MARK_BITS`` bits in all, which is what is broadcast. A fuller
    bitmap lets more rows pass, none is lost."""
    bit = F.pmod(F.xxhash64("doc", "text_hash"), F.lit(MARK_BITS))
    bitmaps = saved(wanted.select((bit + 1).alias("_n"))
                    .groupBy(F.bitmap_bucket_number("_n").alias("_bucket"))
                    .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_n")).alias("_bitmap")), "passage-marks")
    place = bit % F.lit(32768)
    byte = F.conv(F.hex(F.expr("substring(_bitmap, cast(_place div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return (texts.withColumns({"_bucket": F.floor(bit / F.lit(32768)).cast("long") + F.lit(1), "_place": place})
            .join(F.broadcast(bitmaps), "_bucket")
            .where(byte.bitwiseAND(F.expr("shiftleft(1, cast(_place % 8 as int))")) != 0)
            .drop("_bucket", "_place", "_bitmap"))


_CONTEXT = "key long, context long, doc long, text_hash long, start int, size int"


def _contexts(texts: DataFrame) -> DataFrame:
    """The contexts of the shared anchors: ``size`` words from ``start`` on,
    which hold ``size - WINDOW + 1`` windows.

    ``texts``: doc, text_hash, text, small and large (shared anchors)."""
    names = [f.split()[0] for f in _CONTEXT.split(", ")]

    def run(batches):
        for b in batches:
            raw, offsets = text_buffer(b.column(2))
            for lo, hi in blocks(offsets, BLOCK):
                w = Words(raw, offsets[lo:hi + 1])
                hashes = w.hashes()
                starts, best, by_word = anchors(w, hashes)
                doc_of = w.doc()
                doc = doc_of[starts]
                small, large = (np.zeros(len(starts), bool) for _ in range(2))
                bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    x, y = bounds[i], bounds[i + 1]
                    mine = by_word[best[x:y]].view(np.int64)
                    for flags, column in ((small, 3), (large, 4)):
                        wanted = b.column(column)[lo + i].values
                        if wanted is not None and len(wanted):
                            flags[x:y] = np.isin(mine, wanted.to_numpy(zero_copy_only=False))
                # a run of windows with the same anchor is one context
                run_head = np.ones(len(starts), bool)
                run_head[1:] = (best[1:] != best[:-1]) | (np.diff(starts) != 1)
                head = np.flatnonzero((small & run_head) | large)
                ends = np.append(np.flatnonzero(run_head), len(starts))
                count = np.where(large[head], 1, ends[np.searchsorted(ends, head, "right")] - head)
                first, size = starts[head], count + WINDOW - 1
                begin = np.cumsum(size) - size
                flat = hashes[np.repeat(first - begin, size) + np.arange(size.sum())] if len(head) else np.zeros(0, np.uint64)
                # identity of the context: its words and their number
                order = np.arange(len(flat), dtype=np.uint64) - np.repeat(begin, size).astype(np.uint64)
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(flat + order * np.uint64(0x9E3779B97F4A7C15)))))
                context = mix(total[begin + size] - total[begin] + size.astype(np.uint64))
                # with its anchor a context is known by 128 bits; a single window by a second hash of its words
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix((flat ^ np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x165667B19E3779F9)
                                                                              + order * np.uint64(0xFF51AFD7ED558CCD)))))
                key = np.where(large[head], mix(total[begin + size] - total[begin]), by_word[best[head]])
                row = pa.array(doc[head] + lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(context.view(np.int64)), b.column(0).take(row), b.column(1).take(row),
                     pa.array((first - w.first[doc[head]]).astype(np.int32)), pa.array(size.astype(np.int32))], names)

    return texts.select("doc", "text_hash", "text", "small", "large").mapInArrow(run, _CONTEXT)


def _words_of(texts: DataFrame, open_: DataFrame) -> DataFrame:
    """key, context, owner, words: six bytes of each word's hash, taken from
    the first copy of each open context."""

    def run(batches):
        for b in batches:
            raw, offsets = text_buffer(b.column(1))
            for lo, hi in blocks(offsets, BLOCK):
                keys, contexts, owners, words = [], [], [], []
                w = Words(raw, offsets[lo:hi + 1])
                packed = np.ascontiguousarray(w.hashes().view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
                for i in range(hi - lo):
                    owner = b.column(0)[lo + i].as_py()
                    for c in b.column(2)[lo + i].as_py():
                        at = int(w.first[i]) + c["start"]
                        keys.append(c["key"])
                        contexts.append(c["context"])
                        owners.append(owner)
                        words.append(packed[6 * at:6 * (at + c["size"])])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(contexts, pa.int64()), pa.array(owners, pa.int64()), pa.array(words, pa.binary())],
                    ["key", "context", "owner", "words"])

    wanted = open_.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("key", "context", "start", "size")).alias("wanted"))
    return (_marked(texts.select("doc", "text_hash", "text"), open_).join(wanted, ["doc", "text_hash"]).select("doc", "text", "wanted")
            .mapInArrow(run, "key long, context long, owner long, words binary"))


def _owners(words: DataFrame) -> DataFrame:
    """key, context, owners: for each window of each context the smallest
    document that holds it in any context of the shard."""

    def solve(rows: list[tuple]) -> list[list[int]]:
        """rows: (owner, words) of all contexts of a key."""
        sequences = []
        for _, words in rows:
            wide = np.zeros((len(words) // 6, 8), np.uint8)
            wide[:, :6] = np.frombuffer(words, np.uint8).reshape(-1, 6)
            sequences.append(wide.view(np.uint64).ravel().tolist())
        automaton = SuffixAutomaton()
        for (owner, _), s in zip(rows, sequences, strict=True):
            automaton.add(s, owner)
        automaton.finish()
        return [automaton.owners(s, WINDOW) for s in sequences]

    def run(batches):
        held: list[tuple] = []

        def emit(rows):
            out = []
            a = 0
            while a < len(rows):
                z = a
                while z < len(rows) and rows[z][0] == rows[a][0]:
                    z += 1
                out += solve([(r[2], r[3]) for r in rows[a:z]])
                a = z
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array(out, pa.list_(pa.int64()))], ["key", "context", "owners"])

        for b in batches:
            rows = held + list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            if not rows:
                continue
            cut = len(rows)
            while cut and rows[cut - 1][0] == rows[-1][0]:      # the last key may go on
                cut -= 1
            held = rows[cut:]
            if cut:
                yield emit(rows[:cut])
        if held:
            yield emit(held)

    return (words.repartition("key").sortWithinPartitions("key").select("key", "context", "owner", "words")
            .mapInArrow(run, "key long, context long, owners array<long>"))


def _single_windows(words: DataFrame) -> DataFrame:
    """The same for anchors with very many contexts: equal windows are merged
    by a hash of their words."""
    size = 6 * WINDOW

    def run(batches):
        for b in batches:
            keys, contexts, firsts, owners, sums = [], [], [], [], []
            for key, context, owner, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n = len(body) // 6 - WINDOW + 1
                keys += [key] * n
                contexts += [context] * n
                firsts += range(n)
                owners += [owner] * n
                sums += [hashlib.blake2b(body[i:i + size], digest_size=16).digest() for i in range(0, 6 * n, 6)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(contexts, pa.int64()), pa.array(firsts, pa.int64()), pa.array(owners, pa.int64()),
                 pa.array(sums, pa.binary())], ["key", "context", "first", "owner", "window"])

    windows = saved(words.select("key", "context", "owner", "words")
                    .mapInArrow(run, "key long, context long, first long, owner long, window binary"), "passage-single-windows")
    least = saved(windows.groupBy("key", "window").agg(F.min("owner").alias("least")), "passage-window-owners")
    in_order = F.sort_array(F.collect_list(F.struct("first", "least")))
    return (windows.join(least, ["key", "window"]).groupBy("key", "context").agg(in_order.alias("w"))
            .select("key", "context", F.col("w.least").alias("owners")))


def repeated_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summaries of all rows with ``copy``: the word sequence is a smaller
    document's; texts of suspects; doc, text_hash, starts: windows that go)."""
    rows = saved(_summaries(docs), "passage-summaries")
    same = ["words_sha256", "n_words"]
    first = saved(rows.groupBy(*same).agg(F.min("doc").alias("owner")), "passage-owners")
    rows = rows.join(first, same).withColumn("copy", F.col("owner") < F.col("doc"))
    copies = saved(rows.where("copy").select("doc", "text_hash").distinct(), "passage-copies")
    # 16 bytes a row; a longer list is joined by a shuffle
    known = F.broadcast(copies) if copies.count() <= MAX_BROADCAST_COPIES else copies
    # two passes read the anchors: they are computed once
    dealt = saved(_anchor_rows(_keyed(docs).join(known, ["doc", "text_hash"], "left_anti")), "passage-dealt")
    shared = saved(dealt.groupBy("anchor").agg(F.min("doc").alias("x"), F.max("doc").alias("y"), F.count(F.lit(1)).alias("n"))
                   .where("x < y").select("anchor", (F.col("n") > MAX_SHARD).alias("many")), "passage-anchors")
    hits = (dealt.join(shared, "anchor").groupBy(F.col("doc").alias("_row"))
            .agg(F.collect_set(F.when(~F.col("many"), F.col("anchor"))).alias("small"),
                 F.collect_set(F.when(F.col("many"), F.col("anchor"))).alias("large")))
    texts = saved(_keyed(docs).withColumn("_row", _row_key(F.col("doc"), F.col("text_hash"))).join(hits, "_row")
                  .dropDuplicates(["_row", "doc", "text_hash"]).drop("_row"), "passage-texts")      # in the join's partitions
    contexts = saved(_contexts(texts), "passage-contexts")
    one = ["key", "context"]
    distinct = saved(contexts.groupBy(*one).agg(F.min(F.struct("doc", "text_hash", "start", "size")).alias("at")), "passage-distinct")
    shards = saved(distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                   .select("key", (F.col("n") > MAX_SHARD).alias("many")), "passage-shards")

    def words(of: DataFrame) -> DataFrame:
        return _words_of(texts, saved(distinct.join(of, "key").select(*one, "at.*"), "passage-open"))

    found = _owners(words(shards.where("not many")))
    if not shards.where("many").isEmpty():       # rare: the texts are then read once more
        found = found.unionByName(_single_windows(words(shards.where("many"))))
    # alone with its anchor: the smallest document of the context holds all its windows
    alone = F.array_repeat("at.doc", F.col("at.size") - WINDOW + 1)
    owners = saved(distinct.join(found, one, "left").select(*one, F.coalesce("owners", alone).alias("owners")), "passage-windows")
    gone = (contexts.join(owners, one)
            .select("doc", "text_hash", F.expr(
                "transform(filter(sequence(0, size(owners) - 1), i -> owners[i] < doc), i -> start + i)").alias("starts"))
            .where(F.size("starts") > 0).groupBy("doc", "text_hash")
            .agg(F.flatten(F.collect_list("starts")).alias("starts")))
    return rows, texts, gone


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, n_removed, spans (array of [start, end) word
    ranges removed; null: the whole text), kept_text (null if nothing goes or
    all), kept_sha256 of the kept words joined by one space."""
    rows, texts, gone = repeated_windows(docs)
    gone = saved(gone, "passage-gone")

    def cut(batches):
        for b in batches:
            raw, offsets = text_buffer(b.column(2))
            for lo, hi in blocks(offsets, BLOCK):
                removed, spans, kept, sums = [], [], [], []
                w = Words(raw, offsets[lo:hi + 1])
                data = w.data.tobytes()
                for i, (x, y) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
                    starts = np.unique(b.column(3)[lo + i].values.to_numpy(zero_copy_only=False))
                    mark = np.zeros(y - x + 1, int)
                    np.add.at(mark, starts, 1)
                    np.add.at(mark, starts + WINDOW, -1)
                    out = np.concatenate(([False], np.cumsum(mark)[:-1] > 0, [False]))
                    edges = np.flatnonzero(out[1:] != out[:-1])
                    spans.append(edges.reshape(-1, 2).tolist())
                    keep = x + np.flatnonzero(~out[1:-1])
                    body = b" ".join([data[s:e] for s, e in zip(w.start[keep].tolist(), w.end[keep].tolist(), strict=True)])
                    removed.append(y - x - len(keep))
                    kept.append(body.decode())
                    sums.append(hashlib.sha256(body).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[lo:hi], b.column(1)[lo:hi], pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                     pa.array(kept, pa.string()), pa.array(sums, pa.string())],
                    ["doc", "text_hash", "cut_words", "spans", "kept_text", "cut_sha256"])

    cuts = (_marked(texts.select("doc", "text_hash", "text"), gone).join(gone, ["doc", "text_hash"])
            .select("doc", "text_hash", "text", "starts")
            .mapInArrow(cut, "doc long, text_hash long, cut_words long, spans array<array<long>>, kept_text string, cut_sha256 string"))
    whole = F.col("copy") & (F.col("n_words") >= WINDOW)
    empty = hashlib.sha256(b"").hexdigest()
    return (rows.select("doc", "text_hash", "n_words", "words_sha256", "copy").join(cuts, ["doc", "text_hash"], "left")
            .select(F.when(F.col("doc") < _NO_ID, F.col("doc")).alias("doc_id"), "text_hash", "n_words",
                    F.when(whole, F.col("n_words")).otherwise(F.coalesce("cut_words", F.lit(0))).cast("long").alias("n_removed"),
                    F.when(~whole, F.coalesce("spans", F.array().cast("array<array<long>>"))).alias("spans"),
                    F.when(~whole, F.col("kept_text")).alias("kept_text"),
                    F.when(whole, F.lit(empty)).otherwise(F.coalesce("cut_sha256", "words_sha256")).alias("kept_sha256")))


def drop_repeated_passages(docs: DataFrame) -> DataFrame:
    """``docs`` (all columns), the words of repeated passages removed from
    ``text``; texts that lose nothing stay as they are."""
    key, th, cut, body = fresh(docs, "_key", "_th", "_cut", "_body")
    changed = (substring_dedup(docs).where("n_removed > 0")
               .select(F.coalesce("doc_id", F.lit(_NO_ID)).alias(key), F.col("text_hash").alias(th),
                       F.lit(True).alias(cut), F.coalesce("kept_text", F.lit("")).alias(body))
               .dropDuplicates([key, th]))
    joined = (docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), th: F.xxhash64("text")})
              .join(changed, [key, th], "left"))
    return joined.select(*[F.when(F.col(cut), F.col(body)).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c)
                           for c in docs.columns])
