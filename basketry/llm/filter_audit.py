"""Interaction audit of document filters from sorted posting lists.

Which filter removes a document depends on the order of the filters. The audit
counts, for every order, what each step removes, without running any order:

1. ``filter_failures``: the failing conditions of every document, and a
   document-level duplicate test over the whole table.
2. ``posting_lists``: documents are range-partitioned by (part, doc_id), so a
   large part spreads over tasks; each (part, id range) keeps, for each filter,
   the sorted list of the rows that fail it, as numbers within the range, and
   such lists of good and of toxic rows.
3. ``list_sizes``: in each range a k-way galloping merge gives the union of
   every set of filters, the galloping difference of a filter's list and that
   union is what the filter removes after the set, and galloping intersections
   with the label lists what of it is good or toxic. Only sizes leave the task;
   they are summed over the ranges.
4. ``filter_audit``: a step of an order removes what its filter removes after
   the set of filters before it, so all orders are read off the summed sizes.

Edge cases. Null text is an empty one, a null source is the empty part. A null
doc_id counts as larger than any other. Repeated rows are documents of their
own; none of them is smaller than the other. Several labels of one doc_id:
good (toxic) if any of them says so. Documents without a label are neither.
An empty table gives no rows; empty labels give zeros. Further columns are
ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.workdir import saved

FILTERS = "ABCDE"
RANGE_ROWS = 1 << 18            # rows of one posting range
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"


def conditions(text: Column) -> dict[str, Column]:
    """Failure conditions that a document's own text decides."""
    words = F.filter(F.split(text, WORD_SPLIT), lambda w: w != "")
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": F.size(words) < 200,
            "B": F.size(F.array_distinct(words)) * F.lit(100).cast("long") < F.size(words) * F.lit(50).cast("long"),
            "C": upper * F.lit(100).cast("long") > F.length(text) * F.lit(2).cast("long"),
            "D": text.rlike("[#$%&*|]")}


def filter_failures(docs: DataFrame) -> DataFrame:
    """doc_id, part and a boolean for each filter. ``E``: the text is
    identical (by its SHA-256) to that of a smaller doc_id anywhere."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                      F.unhex(F.sha2(text, 256)).alias("_sha"), *[c.alias(k) for k, c in conditions(text).items()])
    own = saved(own, "audit-own")
    # only repeated texts meet their first document; both sides are plain scans, so that a hot text's join can split
    first = (own.groupBy("_sha").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
             .where((F.col("_n") > 1) & F.col("_first").isNotNull()).select("_sha", "_first"))
    joined = own.join(saved(first, "audit-first"), "_sha", "left")
    later = F.col("_first").isNotNull() & (F.col("doc_id").isNull() | (F.col("_first") < F.col("doc_id")))
    return joined.select("doc_id", "part", "A", "B", "C", "D", later.alias("E"))


def _labelled(failures: DataFrame, labels: DataFrame) -> DataFrame:
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("_good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("_toxic"))
    marks = saved(marks.where(F.col("doc_id").isNotNull() & (F.col("_good") | F.col("_toxic"))), "audit-labels")
    return failures.join(marks, "doc_id", "left").select(
        "doc_id", "part", *FILTERS, F.coalesce("_good", F.lit(False)).alias("good"), F.coalesce("_toxic", F.lit(False)).alias("toxic"))


LISTS = "part string, first_id long, last_id long, n long, " + ", ".join(f"`{c}` array<int>" for c in (*FILTERS, "good", "toxic"))


def posting_lists(labelled: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """LISTS rows: for each part and id range the ascending numbers, within
    the range, of the rows that fail each filter, are good, are toxic."""
    keys = [F.col("part"), F.col("doc_id").asc_nulls_last(), F.col("_tie")]
    # a row's own number splits repeated ids
    ranged = (labelled.withColumn("_tie", F.monotonically_increasing_id())
              .repartitionByRange(*keys).sortWithinPartitions(*keys[:2]).drop("_tie"))
    names = [c.strip("`") for c in (f.split()[0] for f in LISTS.split(", "))]
    schema = pa.schema([("part", pa.string()), *((c, pa.int64()) for c in names[1:4]), *((c, pa.list_(pa.int32())) for c in names[4:])])

    def lists(part, ids, flags):
        ends = pc.min_max(pa.chunked_array(ids, pa.int64()))
        row = {"part": [part], "first_id": [ends["min"].as_py()], "last_id": [ends["max"].as_py()], "n": [len(flags)]}
        row |= {c: [np.flatnonzero(flags[:, k]).astype(np.int32)] for k, c in enumerate(names[4:])}
        return pa.RecordBatch.from_pydict(row, schema=schema)

    def run(batches):
        part, ids, flags, size = None, [], [], 0
        for b in batches:
            parts = b.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(parts[1:] != parts[:-1]) + 1 if len(parts) else np.zeros(0, int)
            marks = np.column_stack([b.column(k).to_numpy(zero_copy_only=False).astype(bool) for k in range(2, 9)])
            for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(parts)), strict=True):
                while lo < hi:
                    if size and (parts[lo] != part or size >= range_rows):
                        yield lists(part, ids, np.concatenate(flags))
                        ids, flags, size = [], [], 0
                    part, n = parts[lo], min(hi - lo, range_rows - size)
                    ids.append(b.column(0).slice(lo, n))
                    flags.append(marks[lo:lo + n])
                    lo, size = lo + n, size + n
        if size:
            yield lists(part, ids, np.concatenate(flags))

    return ranged.select("doc_id", "part", *FILTERS, "good", "toxic").mapInArrow(run, LISTS)


# set operations on sorted lists

def gallop(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Where ``keys`` would stand in ``among`` (both ascending): steps that
    double until they pass the key, then a binary search in the last step,
    for all keys at once, each from its predecessor's place."""
    if len(keys) * 8 > len(among):                 # dense keys: steps would all be short
        return np.searchsorted(among, keys)
    lo = np.searchsorted(among[::64], keys) * 64 - 64        # the skip list's stretch of 64
    lo = np.maximum(lo, 0)
    hi = np.minimum(lo + 65, len(among))
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        less = open_ & (among[np.minimum(mid, len(among) - 1)] < keys)
        lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
    return lo


def contained(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """For each of ``keys`` whether ``among`` holds it."""
    if not len(among) or not len(keys):
        return np.zeros(len(keys), bool)
    if len(keys) > len(among):                     # gallop with the shorter list
        out = np.zeros(len(keys), bool)
        at = gallop(among, keys)
        hit = at < len(keys)
        hit[hit] = keys[at[hit]] == among[hit]
        out[at[hit]] = True
        return out
    at = gallop(keys, among)
    inside = at < len(among)
    inside[inside] = among[at[inside]] == keys[inside]
    return inside


def union(lists: list[np.ndarray]) -> np.ndarray:
    """K-way merge: the longest list takes in what it lacks of the others."""
    lists = sorted(lists, key=len, reverse=True)
    out = lists[0]
    for more in lists[1:]:
        new = more[~contained(more, out)]
        out = np.insert(out, gallop(new, out), new)
    return out


SIZES = "part string, n long, filter int, before int, removed long, good_lost long, toxic_lost long"


def list_sizes(lists: DataFrame) -> DataFrame:
    """SIZES rows summed over the id ranges: how many rows fail ``filter``
    and none of the filters in the bit set ``before``."""
    k = len(FILTERS)
    names = [f.split()[0] for f in SIZES.split(", ")]

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                own = [b.column(4 + j)[row].values.to_numpy() for j in range(k + 2)]
                out, gone_after = [], [np.zeros(0, np.int32)]
                for before in range(1 << k):
                    if before:         # the set without its first filter is merged already
                        rest = before & (before - 1)
                        gone_after.append(union([gone_after[rest], own[(before ^ rest).bit_length() - 1]]))
                    gone = gone_after[before]
                    for j in range(k):
                        if before >> j & 1:
                            continue
                        removed = own[j][~contained(own[j], gone)]
                        out.append((j, before, len(removed), int(contained(removed, own[k]).sum()), int(contained(removed, own[k + 1]).sum())))
                n = len(out)
                columns = [pa.array([b.column(0)[row].as_py()] * n), pa.array([b.column(3)[row].as_py()] * n),
                           *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32()] * 2 + [pa.int64()] * 3, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return (lists.mapInArrow(run, SIZES).groupBy("part", "filter", "before")
            .agg(*[F.sum(c).alias(c) for c in ("n", "removed", "good_lost", "toxic_lost")]))


def _orders(spark) -> DataFrame:
    """A row for each step of each order: as many as the filters have, not the data."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(FILTERS[x] for x in order), step, f, before))
            before |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, filter int, before int")


def filter_audit(docs: DataFrame, labels: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley: 600 rows a part."""
    failures = _labelled(filter_failures(docs), labels)
    lists = saved(posting_lists(failures, range_rows), "audit-lists")
    sizes = list_sizes(lists)
    k, of = len(FILTERS), Window.partitionBy("part", "filter")
    # in how many orders exactly these filters come before
    orders = sum((F.when(F.bit_count("before") == m, F.lit(factorial(m) * factorial(k - 1 - m))).otherwise(F.lit(0))
                  for m in range(k)), F.lit(0)).cast("long")
    others = F.lit((1 << k) - 1) - F.expr("shiftleft(1, filter)")
    sizes = sizes.withColumns({
        "_all": F.sum(F.when(F.col("before") == 0, F.col("removed")).otherwise(F.lit(0))).over(of),
        "unique_fails": F.sum(F.when(F.col("before") == others, F.col("removed")).otherwise(F.lit(0))).over(of),
        "shapley": F.sum(F.col("removed") * orders).over(of)})
    steps = F.broadcast(_orders(docs.sparkSession))        # 600 rows, whatever the input
    so_far = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return (sizes.join(steps, ["filter", "before"])
            .select("part", "filter_order", "step", (F.col("n") - F.sum("removed").over(so_far)).alias("kept"), "removed",
                    (F.col("_all") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley"))
