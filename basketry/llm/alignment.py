"""Alignment of two tokenizers' ids over the same text, with corpus-wide
counts of linked id pairs by external spill counting.

Tokenizer A is a byte-level BPE (a ``tokenizers`` file), B a sentencepiece
model that puts a space before a text. Both read the space and the text, so
their tokens cover the same bytes. Byte offsets where tokens of both end cut a
document into groups; tokens whose byte ranges overlap are linked.

1. ``aligned_units``: documents are read in units of a few MB. A unit's
   pair-document records are sorted, its pairs counted once for each document
   that holds them, radix-partitioned by the low digits of the A id, and each
   part is written as a run: (A id, B id)-ordered chunks, zstd frames each. The
   links of each document stay in the unit as places in those runs.
2. ``count_pairs``: a task merges up to ``FAN_IN`` runs of one radix with a
   k-way heap merge, a chunk of each run in memory. Beyond that many runs they
   are merged in levels. A hot pair is one record a unit, whatever the number
   of documents that hold it.
3. Runs are A-major: an A id's pairs are complete when the merge leaves it, so
   its highest count is known there, and the merge streams (count, is highest)
   back to every run in the run's own order, level by level.
4. Each unit adds up what came back over its documents' links.

Edge cases. Null or empty text, or one whose tokens of either side do not spell
the space and the text (such as texts with U+2581, which B takes for a space):
no tokens, zeros and ''. Repeated rows and rows with null doc_id are documents
of their own, also in the counts. An empty table gives no rows. Further columns
are ignored. A text longer than a unit is a unit of its own.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.bpe import byte_of_char, tokenizer
from basketry.llm.chunks import ChunkIds
from basketry.llm.text import U, blocks, text_buffer
from basketry.llm.workdir import saved

RADIX = 128                  # parts of a unit's pairs, by the low digits of the A id
FAN_IN = 256                 # runs that one task merges
CHUNK = 8192                 # records of a run that are in memory at once
UNIT_BYTES = 8 << 20         # text of a unit
UNIT_RECORDS = 1_500_000     # or pair-document records, whichever comes first
FLUSH = 1 << 20              # records that stream back in one row
SPACE_MARK = "▁"        # B's sign for a space


# the two vocabularies

class Side:
    """Token bytes of a vocabulary as flat arrays."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.at = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        size = self.length[ids]
        total = np.cumsum(size)
        return self.bytes[np.repeat(self.at[ids] - (total - size), size) + np.arange(total[-1] if len(ids) else 0)]


@lru_cache(maxsize=2)
def side_a(path: str) -> Side:
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    vocab = dict(file["model"]["vocab"])
    chars = byte_of_char()
    tokens = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        tokens[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
    return Side(tokens)


class PieceTokenizer(Side):
    """A sentencepiece model whose pieces have the space sign in front only:
    a run of spaces and the characters up to the next space are a chunk that
    no piece leaves, so chunks can be encoded one by one."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces):
            raise ValueError(f"{path}: pieces go on after a space, texts can't be cut there")
        super().__init__([bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else p.replace(SPACE_MARK, " ").encode()
                          for i, p in enumerate(pieces)])
        self._space = [self._model.piece_to_id(SPACE_MARK)]
        self._chunks = ChunkIds(self._encode)

    def _encode(self, chunks: list[bytes]) -> list[list[int]]:
        # the model adds the first space itself; nothing but that space is a piece
        out = self._model.encode([c[1:].decode() for c in chunks], num_threads=1)
        return [ids if len(c) > 1 else self._space for c, ids in zip(chunks, out, strict=True)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts that each start with the added space."""
        space = data == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[offsets[:-1]] = True
        start = np.flatnonzero(begins)
        ids, size = self._chunks.encode(data, start, np.append(start[1:], len(data)))
        after = np.concatenate(([0], np.cumsum(size)))
        return ids, np.diff(after[np.searchsorted(start, offsets)])


@lru_cache(maxsize=2)
def piece_tokenizer(path: str) -> PieceTokenizer:
    return PieceTokenizer(path)


@lru_cache(maxsize=4)
def _decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """0..size-1 in decimal, each in the first seven bytes of a little-endian
    word (unused bytes are 0), and their numbers of digits."""
    if size > 10 ** 7:
        raise ValueError("ids of more than seven digits")
    digits = (np.arange(size)[:, None] // 10 ** np.arange(6, -1, -1)) % 10
    used = np.maximum.accumulate(digits > 0, axis=1)
    used[:, -1] = True
    text = np.zeros((size, 8), np.uint8)
    text[:, :7] = np.where(used, digits + 48, 0)
    return text.view("<u8")[:, 0].copy(), used.sum(axis=1)


# alignment of a block of texts

class Aligned:
    """Documents of a block (arrays with an entry each) and their distinct
    (document, pair) records, document-major, with multiplicities."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, path_a: str, path_b: str):
        n = len(offsets) - 1
        self.n_a, self.n_b, self.n_groups, self.n_links, self.records = np.zeros((5, n), np.int64)
        self.digest = [""] * n
        self.pair, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        offsets = offsets - offsets[0]
        full = np.flatnonzero(np.diff(offsets))
        if not len(full):
            return
        a_side, b_side = side_a(path_a), piece_tokenizer(path_b)
        # every text with a space before it
        text = np.insert(data, offsets[:-1][full], 32)
        at = np.append(offsets[:-1][full], offsets[-1]) + np.arange(len(full) + 1)
        at[-1] = len(text)
        a, a_count = tokenizer(path_a).encode(text, at)
        b, b_count = b_side.encode(text, at)
        # both sides must spell the text
        good = _spelled(a_side, a, a_count, text, at) & _spelled(b_side, b, b_count, text, at)
        a, b = a[np.repeat(good, a_count)].astype(np.int64), b[np.repeat(good, b_count)].astype(np.int64)
        a_count, b_count, full = a_count[good], b_count[good], full[good]
        stop = np.cumsum((at[1:] - at[:-1])[good])            # ends of the documents that stay
        if not len(full):
            return
        self.n_a[full], self.n_b[full] = a_count, b_count
        a_end, b_end = np.cumsum(a_side.length[a]), np.cumsum(b_side.length[b])
        in_a, in_b = np.zeros((2, stop[-1] + 1), bool)
        in_a[a_end] = in_b[b_end] = True
        both, cut = in_a & in_b, np.flatnonzero(in_a | in_b)
        # each stretch between two cuts is one overlap of an A and a B token
        a_before, b_before, groups = (np.cumsum(x) - x for x in (in_a, in_b, both))
        pair = a[a_before[cut]] * len(b_side.length) + b[b_before[cut]]
        last = np.searchsorted(cut, stop, "right")
        self.n_links[full] = links = np.diff(last, prepend=0)
        ends = np.cumsum(both)[stop]
        self.n_groups[full] = np.diff(ends, prepend=0)
        self._digests(full, a, b, a_end, b_end, both, groups, a_count + b_count)
        # distinct pairs of each document
        key = np.repeat(np.arange(len(full), dtype=np.int64) << 40, links) | pair
        key.sort()
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.times = np.diff(np.append(first, len(key)))
        key = key[first]
        self.pair = key & ((1 << 40) - 1)
        self.records[full] = np.bincount(key >> 40, minlength=len(full))

    def _digests(self, full, a, b, a_end, b_end, both, groups, tokens) -> None:
        """A ids of a group, '|', its B ids, ';' and the next group."""
        a_group, b_group = groups[a_end], groups[b_end]
        n = int(groups[a_end[-1]]) + 1
        a_in, b_in = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
        decimal, width = _decimals(1 << max(int(a.max()), int(b.max())).bit_length())
        rows, size = np.zeros(len(a) + len(b), "<u8"), np.zeros(len(a) + len(b), np.int64)
        for ids, end, place, mark in ((a, a_end, np.arange(len(a)) + (np.cumsum(b_in) - b_in)[a_group], b"|"),
                                      (b, b_end, np.arange(len(b)) + np.cumsum(a_in)[b_group], b";")):
            rows[place] = decimal[ids] | (np.where(both[end], U(mark[0]), U(ord(","))) << U(56))
            size[place] = width[ids] + 1
        flat = rows.tobytes().translate(None, b"\0")
        stop = np.cumsum(size)[np.cumsum(tokens) - 1].tolist()
        start = 0
        for k, end in zip(full.tolist(), stop, strict=True):
            self.digest[k] = hashlib.sha256(flat[start:end - 1]).hexdigest()
            start = end


def _spelled(side: Side, ids: np.ndarray, count: np.ndarray, text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each text whether its ids spell it."""
    size = side.length[ids]
    after = np.concatenate(([0], np.cumsum(size)))
    spelled = np.diff(after[np.concatenate(([0], np.cumsum(count)))])
    ok = spelled == np.diff(at)
    ids, text = ids[np.repeat(ok, count)], text[np.repeat(ok, np.diff(at))]
    bad = np.concatenate(([0], np.cumsum(side.spell(ids) != text)))
    ok[np.flatnonzero(ok)] = np.diff(bad[np.concatenate(([0], np.cumsum(np.diff(at)[ok])))]) == 0
    return ok


# runs: chunks of (pair, count), each a zstd frame behind its length

def _packed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def write_run(pair: np.ndarray, count: np.ndarray) -> bytes:
    out = []
    for k in range(0, len(pair), CHUNK):
        part = pair[k:k + CHUNK]
        frame = _packed(np.diff(part, prepend=0).astype("<i8"), count[k:k + CHUNK].astype("<i8"))
        out += [len(frame).to_bytes(4, "little"), frame]
    return b"".join(out)


class Run:
    """Reads a run; always holds a whole A id at least, or all that is left."""

    def __init__(self, blob: bytes, b_size: int):
        self._blob, self._at, self._b = memoryview(blob), 0, b_size
        self._zstd = zstandard.ZstdDecompressor()
        self.pair = self.count = np.zeros(0, np.int64)
        self.fill()

    @property
    def ended(self) -> bool:
        return self._at >= len(self._blob)

    def fill(self) -> None:
        while not self.ended and (not len(self.pair) or self.pair[0] // self._b == self.pair[-1] // self._b):
            n = int.from_bytes(self._blob[self._at:self._at + 4], "little")
            raw = np.frombuffer(self._zstd.decompress(bytes(self._blob[self._at + 4:self._at + 4 + n])), "<i8")
            self._at += 4 + n
            half = len(raw) // 2
            self.pair = np.concatenate((self.pair, np.cumsum(raw[:half])))
            self.count = np.concatenate((self.count, raw[half:]))

    def head(self) -> int:
        """The A id that may go on in the next chunk; none after the last."""
        return int(self.pair[-1] // self._b) if not self.ended else np.iinfo(np.int64).max

    def take(self, below: int) -> tuple[np.ndarray, np.ndarray]:
        """The records of A ids under ``below``."""
        n = len(self.pair) if self.ended and below == np.iinfo(np.int64).max else int(np.searchsorted(self.pair, below * self._b))
        out = self.pair[:n], self.count[:n]
        self.pair, self.count = self.pair[n:], self.count[n:]
        self.fill()
        return out


def merged(runs: list[Run]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """K-way heap merge: (pairs, counts, for each run the places of its
    records among them), whole A ids at a time, in ascending order. The heap
    holds each run under the first A id that may be incomplete in memory."""
    heap = [(r.head(), k) for k, r in enumerate(runs)]
    heapq.heapify(heap)
    while any(len(r.pair) for r in runs):
        below = heap[0][0]
        taken = [r.take(below) for r in runs]
        while heap and heap[0][0] == below and below != np.iinfo(np.int64).max:
            heapq.heapreplace(heap, (runs[heap[0][1]].head(), heap[0][1]))
        pairs = np.concatenate([p for p, _ in taken])
        different, which = np.unique(pairs, return_inverse=True)
        counts = np.bincount(which, np.concatenate([c for _, c in taken]).astype(np.float64),
                             len(different)).astype(np.int64)     # exact below 2**53
        yield different, counts, np.split(which, np.cumsum([len(p) for p, _ in taken])[:-1])


def _is_highest(pairs: np.ndarray, counts: np.ndarray, b_size: int) -> np.ndarray:
    a = pairs // b_size
    first = np.flatnonzero(np.diff(a, prepend=-1))
    return counts == np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(a))))


BACK = "radix int, node long, seq long, totals binary"


def _signed_totals(counts: np.ndarray, best: np.ndarray) -> np.ndarray:
    return counts * 2 + best


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<i8")


def stream_back(radix: int, nodes: list[int], blobs: list[bytes], b_size: int,
                totals: np.ndarray | None = None) -> Iterator[tuple]:
    """BACK rows: to each run, in its order, twice the pair's corpus-wide
    count, plus one if its A id has no higher. ``totals``: of the merged
    pairs, where a higher level has them already."""
    runs = [Run(b, b_size) for b in blobs]
    held: list[list[np.ndarray]] = [[] for _ in runs]
    seq, size, at = 0, 0, 0
    for pairs, counts, places in merged(runs):
        if totals is None:
            value = _signed_totals(counts, _is_highest(pairs, counts, b_size))
        else:
            value = totals[at:at + len(pairs)]
            at += len(pairs)
        for k, p in enumerate(places):
            held[k].append(value[p])
        size += sum(map(len, places))
        if size >= FLUSH:
            yield from _flushed(radix, nodes, seq, held)
            seq, size, held = seq + 1, 0, [[] for _ in runs]
    yield from _flushed(radix, nodes, seq, held)


def _flushed(radix, nodes, seq, held):
    for node, parts in zip(nodes, held, strict=True):
        values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        if len(values):
            yield radix, node, seq, _packed(values.astype("<i8"))


# Spark

UNIT = ("unit long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
        "groups_sha256 array<string>, runs array<binary>, links binary")


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _unit_row(unit: int, ids: list, parts: list[Aligned], b_size: int) -> tuple:
    pair = np.concatenate([p.pair for p in parts])
    times = np.concatenate([p.times for p in parts])
    per_doc = np.concatenate([p.records for p in parts])
    # the unit's pairs, by radix and then in order
    different, which, docs = np.unique(pair, return_inverse=True, return_counts=True)
    radix = (different // b_size) % RADIX
    order = np.argsort(radix, kind="stable")
    bounds = np.searchsorted(radix[order], np.arange(RADIX + 1))
    runs = [write_run(different[order[x:y]], docs[order[x:y]]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    links = _packed(np.array([len(per_doc), len(pair)], "<i8"), per_doc.astype("<u4"), place[which].astype("<u4"), times.astype("<u4"))
    return (unit, ids, *(np.concatenate([getattr(p, c) for p in parts]).tolist() for c in ("n_a", "n_b", "n_groups", "n_links")),
            [d for p in parts for d in p.digest], runs, links)


def aligned_units(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each unit of documents: what is known without the corpus,
    its runs by radix, and its documents' links as places in the runs."""
    arrow = pa.schema([("unit", pa.int64()), ("doc_id", pa.list_(pa.int64())),
                       *((c, pa.list_(pa.int64())) for c in ("n_a", "n_b", "n_groups", "n_links")),
                       ("groups_sha256", pa.list_(pa.string())), ("runs", pa.list_(pa.binary())), ("links", pa.binary())])

    def run(batches):
        from pyspark import TaskContext
        b_size = len(piece_tokenizer(path_b).length)
        unit = TaskContext.get().partitionId() << 32
        ids, parts, size = [], [], 0
        for b in batches:
            raw, offsets = text_buffer(b.column(1))
            for lo, hi in blocks(offsets):
                parts.append(Aligned(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1], path_a, path_b))
                ids += b.column(0).slice(lo, hi - lo).to_pylist()
                size += int(offsets[hi] - offsets[lo])
                if size >= UNIT_BYTES or sum(len(p.pair) for p in parts) >= UNIT_RECORDS:
                    yield from _table([_unit_row(unit, ids, parts, b_size)], arrow).to_batches()
                    unit, ids, parts, size = unit + 1, [], [], 0
        if ids:
            yield from _table([_unit_row(unit, ids, parts, b_size)], arrow).to_batches()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, UNIT)


def _parent(node: str, level: int, groups: int):
    return F.pmod(F.xxhash64(F.col(node), F.lit(level)), F.lit(groups))


def count_pairs(runs: DataFrame, nodes: int, b_size: int, fan_in: int = FAN_IN) -> DataFrame:
    """BACK rows for every run (``radix, node, run``) of ``nodes`` nodes."""
    levels = [(runs, 1)]
    run_schema = pa.schema([("radix", pa.int32()), ("node", pa.int64()), ("run", pa.binary())])
    back_schema = pa.schema([("radix", pa.int32()), ("node", pa.int64()), ("seq", pa.int64()), ("totals", pa.binary())])

    def merge(key, table):
        found = [(p, c) for p, c, _ in merged([Run(b, b_size) for b in table["run"].to_pylist()])]
        blob = write_run(np.concatenate([p for p, _ in found]), np.concatenate([c for _, c in found]))
        return _table([(key[0].as_py(), key[1].as_py(), blob)], run_schema)

    def top(key, table):
        return _table(list(stream_back(key[0].as_py(), table["node"].to_pylist(), table["run"].to_pylist(), b_size)), back_schema)

    def down(key, children, above):
        above = above.sort_by("seq")
        totals = np.concatenate([_unpack(t) for t in above["totals"].to_pylist()])
        return _table(list(stream_back(key[0].as_py(), children["node"].to_pylist(), children["run"].to_pylist(), b_size, totals)), back_schema)

    while nodes > fan_in:
        below, level, nodes = levels[-1][0], len(levels), -(-nodes // fan_in)
        grouped = below.groupBy("radix", _parent("node", level, nodes).alias("parent"))
        levels.append((saved(grouped.applyInArrow(merge, "radix int, node long, run binary"), f"align-runs-{level}"), nodes))
    back = saved(levels[-1][0].groupBy("radix").applyInArrow(top, BACK), "align-back")
    for level in range(len(levels) - 1, 0, -1):
        below, groups = levels[level - 1][0], levels[level][1]
        children = below.withColumn("parent", _parent("node", level, groups)).groupBy("radix", "parent")
        above = back.withColumnRenamed("node", "parent").groupBy("radix", "parent")
        back = saved(children.cogroup(above).applyInArrow(down, BACK), f"align-back-{level - 1}")
    return back


def _runs(units: DataFrame) -> DataFrame:
    return (units.select(F.col("unit").alias("node"), F.posexplode("runs").alias("radix", "run"))
            .where(F.length("run") > 0).select("radix", "node", "run"))


DOCUMENT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align_documents(docs: DataFrame, path_a: str, path_b: str, fan_in: int = FAN_IN) -> DataFrame:
    """Per document: tokens of both sides, groups, links, links whose count
    is the highest of their A id, sum of the links' counts, and the digest of
    its groups."""
    units = saved(aligned_units(docs, path_a, path_b), "align-units")
    back = count_pairs(_runs(units), units.count(), len(piece_tokenizer(path_b).length), fan_in)
    schema = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in DOCUMENT.split(", ")])

    def add_up(key, unit, returned):
        if not unit.num_rows:
            return schema.empty_table()
        order = sorted(zip(returned["radix"].to_pylist(), returned["seq"].to_pylist(), returned["totals"].to_pylist(), strict=True))
        values = [_unpack(t) for _, _, t in order]
        values = np.concatenate(values) if values else np.zeros(0, np.int64)
        raw = zstandard.ZstdDecompressor().decompress(unit["links"][0].as_py())
        n, records = np.frombuffer(raw, "<i8", 2)
        per_doc, place, times = np.split(np.frombuffer(raw, "<u4", offset=16), [n, n + records])
        after = np.concatenate(([0], np.cumsum(per_doc.astype(np.int64))))

        def sums(x):
            return np.diff(np.concatenate(([0], np.cumsum(x * times)))[after])

        got = values[place]
        columns = {c: unit[c][0].values for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
        columns |= {"n_best": pa.array(sums(got & 1)), "count_sum": pa.array(sums(got >> 1))}
        return pa.Table.from_arrays([columns[f.name] for f in schema], schema=schema)

    return (units.drop("runs").groupBy("unit").cogroup(back.withColumnRenamed("node", "unit").groupBy("unit"))
            .applyInArrow(add_up, DOCUMENT))


def pair_counts(docs: DataFrame, path_a: str, path_b: str, fan_in: int = FAN_IN) -> DataFrame:
    """a_id, b_id, documents, is_highest of every linked pair of ids: a table
    from one vocabulary to the other."""
    units = saved(aligned_units(docs, path_a, path_b), "align-units")
    b_size = len(piece_tokenizer(path_b).length)
    runs = _runs(units)
    back = count_pairs(runs, units.count(), b_size, fan_in)
    schema = pa.schema([("a_id", pa.int64()), ("b_id", pa.int64()), ("documents", pa.int64()), ("is_highest", pa.bool_())])

    def rows(key, own, returned):
        found = [(p, c) for p, c, _ in merged([Run(b, b_size) for b in own["run"].to_pylist()])]
        pair = np.concatenate([p for p, _ in found]) if found else np.zeros(0, np.int64)
        value = [_unpack(t) for t in returned.sort_by("seq")["totals"].to_pylist()]
        value = np.concatenate(value) if value else np.zeros(0, np.int64)
        return pa.Table.from_arrays([pa.array(pair // b_size), pa.array(pair % b_size), pa.array(value >> 1), pa.array((value & 1) > 0)],
                                    schema=schema)

    return (runs.groupBy("radix", "node").cogroup(back.groupBy("radix", "node"))
            .applyInArrow(rows, "a_id long, b_id long, documents long, is_highest boolean").distinct())
