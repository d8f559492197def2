"""Token ids in seekable binary files.

A file is a run of independent zstandard frames and a trailing seek table, in
the public seekable zstandard layout: any zstandard decoder reads the whole
file, a reader of the table decompresses only the frames it needs. The table
holds each frame's compressed and decompressed size and the low 32 bits of the
XXH64 of its content, which every read verifies.

* Data frames hold ids, little-endian, 2 bytes each if the vocabulary fits and
  4 otherwise, cut at documents (a longer document goes over several frames).
* The last frame is the index: width, end id and, for each document, its
  doc_id, whether it is null, and its number of ids.

``write_token_files`` range-partitions documents by doc_id and streams each
partition into a file of its own in a shared folder. File names are unique to
the attempt and the returned manifest, stored as a table, names the files of
the attempts that counted: a lost executor or a retried task leaves files that
no reader sees. Files are ascending, and so are the documents in them.

Where the ids of a text are those of its pieces between ASCII white space
(``by_words``; true of tokenizers that drop white space before they merge),
each different piece is encoded once. If the vocabulary file also says that
letters, digits and signs are merged apart, or that case is dropped, pieces end
at common ASCII punctuation, or ASCII letters are lower-cased first: fewer
pieces differ, and the ids are the same (tests compare whole texts).

Edge cases. Null text is an empty one (the end id alone). A null doc_id comes
last. Repeated rows and ids are kept; documents of one doc_id are ordered by a
hash of their text. An empty table gives an empty manifest, no file and no
rows. Further columns are ignored. A text is encoded whole, whatever its
length.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.chunks import ChunkIds
from basketry.llm.text import Words, blocks, text_buffer
from basketry.llm.workdir import saved
from basketry.session import ensure_checkpoint_dir

# of the public seekable zstandard layout: fixed values
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
WITH_CHECKSUMS = 0x80

FRAME_IDS = 1 << 16           # ids of a data frame
LEVEL = 3


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that driver and executors share."""
    if "://" not in uri:
        uri = "file://" + os.path.abspath(uri.removeprefix("file:"))
    return pafs.FileSystem.from_uri(uri)


class FileWriter:
    """Streams documents into a file."""

    def __init__(self, out, width: int, end_id: int):
        self._out, self._kind, self._end = out, f"<u{width}", end_id
        self._zstd = zstandard.ZstdCompressor(level=LEVEL)
        self._table: list[tuple[int, int, int]] = []
        self._ids: list[np.ndarray] = []
        self._held = 0
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []

    def _frame(self, raw: bytes) -> None:
        frame = self._zstd.compress(raw)
        self._out.write(frame)
        self._table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def _flush(self) -> None:
        if self._held:
            self._frame(np.concatenate(self._ids).astype(self._kind).tobytes())
            self._ids, self._held = [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """``ids`` with the end id."""
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))
        if self._held and self._held + len(ids) > FRAME_IDS:
            self._flush()
        for k in range(0, len(ids), FRAME_IDS):
            self._ids.append(ids[k:k + FRAME_IDS])
            self._held += len(self._ids[-1])
            if self._held >= FRAME_IDS:
                self._flush()

    def close(self) -> None:
        self._flush()
        null = np.array([x is None for x in self.doc_ids], np.uint8)
        ids = np.array([x or 0 for x in self.doc_ids], "<i8")
        self._frame(struct.pack("<III", int(self._kind[2]), self._end, len(ids)) + ids.tobytes() + null.tobytes()
                    + np.array(self.counts, "<i8").tobytes())
        entries = b"".join(struct.pack("<III", *t) for t in self._table)
        footer = struct.pack("<IBI", len(self._table), WITH_CHECKSUMS, SEEKABLE_MAGIC)
        self._out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)


class FileReader:
    """Reads the seek table and the index, then single frames. ``source``: a
    seekable binary file. ``frames_read`` counts decompressed data frames."""

    def __init__(self, source):
        self._in = source
        self._zstd = zstandard.ZstdDecompressor()
        self.frames_read = 0
        size = source.seek(0, 2)
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & WITH_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        table = np.frombuffer(self._at(size - 9 - 12 * frames, 12 * frames), "<u4").reshape(-1, 3)
        if struct.unpack("<II", self._at(size - 17 - 12 * frames, 8)) != (SKIPPABLE_MAGIC, 12 * frames + 9):
            raise ValueError("damaged seek table")
        self._sizes, self._checks = table[:, 1].astype(np.int64), table[:, 2]
        self._compressed = table[:, 0].astype(np.int64)
        self._starts = np.cumsum(self._compressed) - self._compressed
        index = self._frame(frames - 1)
        self.width, self.end_id, n = struct.unpack_from("<III", index)
        doc_ids = np.frombuffer(index, "<i8", n, 12)
        null = np.frombuffer(index, np.uint8, n, 12 + 8 * n)
        self.counts = np.frombuffer(index, "<i8", n, 12 + 9 * n)
        self.doc_ids = [None if x else int(i) for i, x in zip(doc_ids.tolist(), null.tolist(), strict=True)]
        self.doc_starts = np.cumsum(self.counts) - self.counts            # ids of the file before a document
        held = self._sizes[:-1] // self.width
        self._frame_starts = np.cumsum(held) - held                       # ids of the file before a frame
        self._last: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def _at(self, start: int, size: int) -> bytes:
        self._in.seek(start)
        return self._in.read(size)

    def _frame(self, k: int) -> bytes:
        raw = self._zstd.decompress(self._at(int(self._starts[k]), int(self._compressed[k])), max_output_size=int(self._sizes[k]))
        if len(raw) != self._sizes[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self._checks[k]:
            raise ValueError(f"frame {k}: wrong checksum")
        return raw

    def _ids_of(self, k: int) -> np.ndarray:
        if self._last[0] != k:
            self._last = k, np.frombuffer(self._frame(k), f"<u{self.width}")
            self.frames_read += 1
        return self._last[1]

    def parts(self, doc: int) -> Iterator[np.ndarray]:
        """The ids of the ``doc``-th document, a frame's worth at a time."""
        at, stop = int(self.doc_starts[doc]), int(self.doc_starts[doc] + self.counts[doc])
        k = int(np.searchsorted(self._frame_starts, at, "right")) - 1
        while at < stop:
            ids, base = self._ids_of(k), int(self._frame_starts[k])
            yield ids[at - base:stop - base]
            at, k = base + len(ids), k + 1

    def ids(self, doc: int) -> np.ndarray:
        return np.concatenate([*self.parts(doc), np.zeros(0, f"<u{self.width}")]).astype(np.uint32)


# the pattern of this tokenizer family: a fixed value
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CUT = np.zeros(256, np.uint8)            # 1: letter or digit, 2: a sign that is in no contraction or special token
_CUT[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_CUT[list(b'!"(),-.:;?')] = 2


def _parts(file: dict, kind: str) -> list[dict]:
    """A normalizer or pre-tokenizer as a list of its steps."""
    step = file.get(kind) or {}
    return step.get("normalizers") or step.get("pretokenizers") or [step]


class _Encoder:
    def __init__(self, path: str, by_words: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")       # tasks share the machine already
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.size = self._tokenizer.get_vocab_size(with_added_tokens=True)
        self._words = ChunkIds(lambda chunks: self._batch([c.decode() for c in chunks])) if by_words else None
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self._lower = any(n.get("type") == "Lowercase" for n in _parts(file, "normalizer"))
        self._cut = any(p.get("type") == "Split" and p["pattern"].get("Regex") == WORD_PATTERN for p in _parts(file, "pre_tokenizer"))

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, start and end of every piece, first piece of each text and the end)."""
        if self._lower and b"<|" not in data.tobytes():               # a special token's case counts
            # but for a letter that a combining mark may follow: composing comes first
            upper = (data >= 65) & (data <= 90) & np.append(data[1:] < 128, True)
            data = data + (upper.astype(np.uint8) << 5)
        words = Words(data, offsets)
        if not self._cut or not len(words.start):
            return words.data, words.start, words.end, words.first
        kind = _CUT[words.data]
        # between a letter or digit and such a sign, both ASCII, within a word
        inner = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
        word = np.searchsorted(words.start, inner, "right") - 1
        inner = inner[(word >= 0) & (inner > words.start[word]) & (inner < words.end[word])]
        start, end = np.sort(np.concatenate((words.start, inner))), np.sort(np.concatenate((words.end, inner)))
        return words.data, start, end, np.searchsorted(start, words.offsets)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids of each)."""
        if self._words:
            data, start, end, first = self._pieces(data, offsets - offsets[0])
            ids, size = self._words.encode(data, start, end)
            return ids, np.diff(np.concatenate(([0], np.cumsum(size)))[first])
        raw, at = data.tobytes(), (offsets - offsets[0]).tolist()
        found = self._batch([raw[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)])
        return (np.concatenate([np.array(f, np.uint32) for f in found] or [np.zeros(0, np.uint32)]),
                np.array([len(f) for f in found], np.int64))


@lru_cache(maxsize=2)
def encoder(path: str, by_words: bool) -> _Encoder:
    return _Encoder(path, by_words)


MANIFEST = "file string, part long, n_docs long, n_tokens long, first_id long, last_id long, has_null boolean"


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, by_words: bool, folder: str | None = None) -> DataFrame:
    """Write every document's ids and the end id; returns the manifest."""
    folder = folder or f"{ensure_checkpoint_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    fs, path = store(folder)
    fs.create_dir(path, recursive=True)
    names = [f.split()[0] for f in MANIFEST.split(", ")]

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        encode, writer, out, name = None, None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                encode = encoder(vocabulary, by_words)
                name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.zst"
                fs, path = store(name)
                out = fs.open_output_stream(path, compression=None)        # the frames are compressed already
                writer = FileWriter(out, 2 if max(encode.size, end_id + 1) <= 1 << 16 else 4, end_id)
            raw, offsets = text_buffer(b.column(1))
            for lo, hi in blocks(offsets):
                ids, counts = encode.encode(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1])
                after = np.cumsum(counts)
                ids = np.insert(ids, after, np.uint32(end_id))
                ends = after + np.arange(1, len(after) + 1)
                for doc, x, y in zip(b.column(0).slice(lo, hi - lo).to_pylist(), (ends - counts - 1).tolist(), ends.tolist(), strict=True):
                    writer.add(doc, ids[x:y])
        if writer is not None:
            writer.close()
            out.close()
            known = [x for x in writer.doc_ids if x is not None]
            yield pa.RecordBatch.from_pydict(dict(zip(names, (
                [name], [part], [len(writer.counts)], [sum(writer.counts)], pa.array([known[0] if known else None], pa.int64()),
                pa.array([known[-1] if known else None], pa.int64()), [len(known) < len(writer.counts)]), strict=True)))

    # repeated ids are split by text and row number
    keys = [F.col("doc_id").asc_nulls_last(), F.col("_hash"), F.col("_tie")]
    ranged = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
              .withColumns({"_hash": F.xxhash64("text"), "_tie": F.monotonically_increasing_id()})
              .repartitionByRange(*keys).sortWithinPartitions(*keys))
    return saved(ranged.select("doc_id", "text").mapInArrow(run, MANIFEST), "token-files-manifest")


def _one_task_a_file(manifest: DataFrame) -> DataFrame:
    """The manifest with the ids before each file, a row a partition."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)      # a row for each file, not for each document
    files = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))
    return files.repartitionByRange(max(1, manifest.count()), "part")


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked, ids of every
    document, from the files alone."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for b in batches:
            for name, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, path = store(name)
                with fs.open_input_file(path) as f:
                    reader = FileReader(f)
                    for lo in range(0, len(reader.counts), 10_000):
                        docs = range(lo, min(lo + 10_000, len(reader.counts)))
                        crc = []
                        for d in docs:
                            c = 0
                            for part in reader.parts(d):
                                c = zlib.crc32(part.astype("<u4"), c)
                            crc.append(c)
                        columns = [pa.array([reader.doc_ids[d] for d in docs], pa.int64()), pa.array(reader.doc_starts[lo:docs.stop] + before),
                                   pa.array(reader.counts[lo:docs.stop]), pa.array(crc, pa.int64())]
                        if with_ids:
                            columns.append(pa.array([reader.ids(d) for d in docs], pa.list_(pa.int64())))
                        yield pa.RecordBatch.from_arrays(columns, names)

    return _one_task_a_file(manifest).select("file", "before").mapInArrow(run, schema)


def read_documents(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and ids of the documents whose doc_id is in ``wanted``: only
    files that may hold one are opened and only frames that do decompressed."""
    spark = manifest.sparkSession
    # a row for each file
    files = [(r["file"], r["first_id"], r["last_id"]) for r in manifest.orderBy("part").collect() if r["first_id"] is not None]
    first, last = (np.array([f[k] for f in files], np.int64) for k in (1, 2))

    def route(batches):
        for b in batches:
            ids = np.unique(b.column(0).drop_null().to_numpy())
            lo, hi = np.searchsorted(last, ids, "left"), np.searchsorted(first, ids, "right")
            n = np.maximum(hi - lo, 0)
            at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.repeat(ids, n))], ["file_no", "doc_id"])

    def read(key, table):
        name = files[key[0].as_py()][0]
        fs, path = store(name)
        asked = set(table["doc_id"].to_pylist())
        with fs.open_input_file(path) as f:
            reader = FileReader(f)
            found = [(i, reader.ids(d)) for d, i in enumerate(reader.doc_ids) if i in asked]
        return pa.Table.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))],
                                    ["doc_id", "ids"])

    if not files:
        return spark.createDataFrame([], "doc_id long, ids array<long>")
    return (wanted.select(F.col("doc_id").cast("long")).mapInArrow(route, "file_no long, doc_id long").distinct()
            .groupBy("file_no").applyInArrow(read, "doc_id long, ids array<long>"))
