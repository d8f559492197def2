"""Document quality: random Fourier features, ridge, isotonic calibration.

Every document's whole text becomes ``len(STATISTICS)`` statistics (sizes,
shares of character kinds, repetition, shapes of words and lines). With them
standardised, random Fourier features cos(Wx + b) approximate a Gaussian
kernel; the ridge regression of the labels on them is solved from the normal
equations, which every task sums over its rows (one small matrix a task). The
raw scores of a third of the labelled rows, kept out of the regression, are
counted in bins and pooled into a non-decreasing calibration curve.

The labelled rows are at most ``MAX_LABELLED``, chosen by the hash of their
doc_id; scoring covers all rows. Labels, language, source and doc_id are no
inputs. Several labels of one document are averaged, null labels ignored. A
null text is scored as an empty one. Without any usable label every score is
0.5; an empty table gives no rows. Repeated rows get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.text import IS_SEP, LOWER, Words, blocks, text_buffer
from basketry.llm.workdir import fresh, saved

MAX_LABELLED = 200_000       # bound of the training sample
FOURIER = 320                # cosine features
BANDWIDTH = 0.03             # gamma of exp(-gamma |x - y|^2), standardised inputs
RIDGE = 1.0
SEED = 7
BINS = 4096                  # calibration bins over the raw score
THRESHOLD = 0.3
SUM_TASKS = 8

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "word_length", "word_length_spread", "long_words",
    "upper", "lower_case", "digits", "punctuation", "not_ascii", "white",
    "bars", "marks", "stops", "commas", "at_or_slash", "brackets",
    "shouted_words", "marked_words", "distinct_words", "distinct_pairs", "top_word",
    "distinct_lines", "words_a_line", "words_a_stop", "byte_entropy")

_KIND = np.zeros(256, np.uint8)
for _k, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), range(128, 256)), 1):
    _KIND[list(_chars)] = _k
_PUNCT = np.array([33 <= c <= 126 and not chr(c).isalnum() for c in range(256)])
_GROUPS = {"bars": b"|", "marks": b"!#$%&*^~+=<>", "stops": b".?!", "commas": b",;:", "at_or_slash": b"@/\\_",
           "brackets": b"()[]{}"}
_MEMBER = {k: np.isin(np.arange(256), list(v)) for k, v in _GROUPS.items()}


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)


def _distinct(doc: np.ndarray, value: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, count of the most frequent one) of each document."""
    if not len(doc):
        return np.zeros(docs), np.zeros(docs)
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    first = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (v[1:] != v[:-1]))))
    sizes = np.diff(np.append(first, len(d)))
    most = np.zeros(docs)
    np.maximum.at(most, d[first], sizes)
    return np.bincount(d[first], minlength=docs).astype(float), most


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text of a block."""
    w = Words(raw, offsets)
    n, data, at = len(offsets) - 1, w.data, w.offsets
    size = np.diff(at).astype(float)
    some = np.maximum(size, 1)
    words = w.counts.astype(float)
    some_words = np.maximum(words, 1)
    doc = w.doc()
    length = (w.end - w.start).astype(float)
    kinds = _KIND[data]
    upper = kinds == 1
    share = {k: _per_doc(member[data], at) for k, member in _MEMBER.items()}
    mean = np.bincount(doc, length, n) / some_words
    spread = np.sqrt(np.maximum(np.bincount(doc, length ** 2, n) / some_words - mean ** 2, 0))
    ups = np.concatenate(([0], np.cumsum(upper)))
    lows = np.concatenate(([0], np.cumsum(kinds == 2)))
    puncts = np.concatenate(([0], np.cumsum(_PUNCT[data])))
    shouted = (ups[w.end] - ups[w.start] >= 2) & (lows[w.end] == lows[w.start])
    marked = puncts[w.end] - puncts[w.start] >= 2
    hashes = w.hashes()
    kinds_of_word, top = _distinct(doc, hashes, n)
    pair_at, pairs = w.windows(hashes, 2)
    kinds_of_pair, _ = _distinct(doc[pair_at], pairs, n)
    newline = data == 10
    lines = _per_doc(newline, at) + 1
    # a line's hash: the sum of its words' hashes
    ends = np.concatenate(([0], np.cumsum(newline)))
    line_of_word = ends[w.start] + doc            # a new number also where a document starts
    cut = np.flatnonzero(np.concatenate(([True], line_of_word[1:] != line_of_word[:-1]))) if len(doc) else np.zeros(0, int)
    line_hash = np.add.reduceat(hashes * np.uint64(3), cut) if len(cut) else np.zeros(0, np.uint64)
    line_doc = doc[cut]
    kinds_of_line, _ = _distinct(line_doc, line_hash, n)
    full_lines = np.maximum(np.bincount(line_doc, minlength=n), 1)
    low = LOWER[data].astype(np.int64)
    counts = np.bincount(np.repeat(np.arange(n), np.diff(at)) * 256 + low, minlength=256 * n).reshape(n, 256)
    p = counts / some[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    columns = (
        np.log1p(size), np.log1p(words), np.log1p(lines), mean, spread, np.bincount(doc, length > 15, n) / some_words,
        _per_doc(upper, at) / some, _per_doc(kinds == 2, at) / some, _per_doc(kinds == 3, at) / some,
        _per_doc(_PUNCT[data], at) / some, _per_doc(kinds == 4, at) / some, _per_doc(IS_SEP[data], at) / some,
        *(np.sqrt(share[k] / some) for k in _GROUPS),
        np.bincount(doc, shouted, n) / some_words, np.bincount(doc, marked, n) / some_words,
        kinds_of_word / some_words, kinds_of_pair / np.maximum(words - 1, 1), top / some_words,
        kinds_of_line / full_lines, np.log1p(words / lines), np.log1p(words / (share["stops"] + 1)), entropy)
    return np.stack(columns, axis=1)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, stats (array<float>) of every row."""

    def run(batches):
        for b in batches:
            raw, offsets = text_buffer(b.column(2))
            rows = [statistics(raw, offsets[lo:hi + 1]) for lo, hi in blocks(offsets)]
            x = np.concatenate(rows).astype(np.float32) if rows else np.zeros((0, len(STATISTICS)), np.float32)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["doc_id", "text_hash", "stats"])

    return (docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, text_hash long, stats array<float>"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)).astype(float)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    knots: np.ndarray = field(default_factory=lambda: np.zeros(1))
    values: np.ndarray = field(default_factory=lambda: np.full(1, 0.5))
    fourier: int = FOURIER
    seed: int = SEED

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        w = rng.normal(0, np.sqrt(2 * BANDWIDTH), (x.shape[1], self.fourier))
        b = rng.uniform(0, 2 * np.pi, self.fourier)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.cos(z @ w + b) * np.sqrt(2 / self.fourier), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights if self.weights is not None else np.zeros(len(x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def _task_sums(rows: DataFrame, parts) -> list[np.ndarray]:
    """``parts(x, y)`` (a tuple of arrays) summed over each task's rows, then
    over the SUM_TASKS tasks."""

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                new = parts(_matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False))
                total = new if total is None else [a + c for a, c in zip(total, new, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": pa.array([[np.ascontiguousarray(a, float).tobytes() for a in total]],
                                                               pa.list_(pa.binary()))})

    found = [[np.frombuffer(s) for s in r["sums"]] for r in
             rows.select("stats", "label").repartition(SUM_TASKS).mapInArrow(run, "sums array<binary>").collect()]
    return [sum(a) for a in zip(*found, strict=True)] if found else []


def isotonic(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: non-decreasing means of total / weight."""
    stack: list[list[float]] = []
    for w, t in zip(weight, total, strict=True):
        stack.append([w, t, 1])
        while len(stack) > 1 and stack[-2][1] * stack[-1][0] >= stack[-1][1] * stack[-2][0]:
            w2, t2, n2 = stack.pop()
            stack[-1] = [stack[-1][0] + w2, stack[-1][1] + t2, stack[-1][2] + n2]
    return np.concatenate([np.full(int(n), t / w) for w, t, n in stack]) if stack else np.zeros(0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(stats: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> QualityModel:
    """Fit on the labelled rows that are not held out."""
    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
    marked = (one.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.avg("quality").alias("label")))
    n = marked.count()
    if n > max_labelled:
        marked = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(n)) < max_labelled)
    rows = saved(stats.join(marked, "doc_id").select("doc_id", "stats", "label"), "quality-training")
    size = len(STATISTICS)
    sums = _task_sums(rows, lambda x, y: [np.array([len(x)]), x.sum(0), (x * x).sum(0)])
    if not sums:
        return QualityModel(np.zeros(size), np.ones(size))
    mean = sums[1] / sums[0]
    model = QualityModel(mean, np.sqrt(np.maximum(sums[2] / sums[0] - mean ** 2, 1e-8)))
    kept_out = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(3)) == 0

    def normal(x, y):
        f = model.features(x)
        return [f.T @ f, f.T @ y]

    sums = _task_sums(rows.where(~kept_out), normal) or _task_sums(rows, normal)
    gram = sums[0].reshape(FOURIER + 1, FOURIER + 1)
    penalty = np.full(FOURIER + 1, RIDGE)
    penalty[-1] = 1e-6
    model.weights = np.linalg.solve(gram + np.diag(penalty), sums[1])

    def binned(x, y):
        at = np.clip(((model.raw(x) + 1) / 3 * BINS).astype(int), 0, BINS - 1)      # raw scores lie in about -1..2
        return [np.bincount(at, minlength=BINS), np.bincount(at, y, minlength=BINS)]

    count, good = _task_sums(rows.where(kept_out), binned) or _task_sums(rows, binned)
    full = np.flatnonzero(count)
    model.knots = (full + 0.5) / BINS * 3 - 1
    model.values = isotonic(count[full], good[full])
    return model


def _scored(stats: DataFrame, model: QualityModel) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.score(_matrix(b.column(2))))],
                                             ["doc_id", "text_hash", "score"])

    return stats.select("doc_id", "text_hash", "stats").mapInArrow(run, "doc_id long, text_hash long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    stats = saved(document_statistics(docs), "quality-statistics")
    return _scored(stats, train(stats, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (all columns) without the rows scored below ``threshold``."""
    stats = saved(document_statistics(docs), "quality-statistics")
    key, th = fresh(docs, "_key", "_th")
    none = F.lit(-(1 << 63))
    low = (_scored(stats, train(stats, labels)).where(F.col("score") < threshold)
           .select(F.coalesce("doc_id", none).alias(key), F.col("text_hash").alias(th)))
    return (docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), none), th: F.xxhash64("text")})
            .join(low, [key, th], "left_anti").drop(key, th))
