"""Exact distinct counts as mergeable states: bitmaps over dense ids.

``countDistinct`` starts anew for every grouping: each query shuffles all
(group, id) pairs. A bitmap of a group's ids is a state instead: coarser groups
are bitwise ORs of finer ones, and a delta is ORed into what is stored. A
bitmap holds 32,768 ids in 4 KB, so ids must be dense: ``dense_ids`` numbers
the ids that occur, without gaps but for the last bitmaps, whatever their
values (negative and sparse ones included).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET, BITMAP = "_bucket", "_bitmap"
ID, NUMBER = "_id", "_number"


def dense_ids(ids: DataFrame, column: str, parts: int = 0, known: DataFrame | None = None) -> DataFrame:
    """ID, NUMBER: the non-null values of ``column`` that occur, numbered from
    1 on. Values are hashed into ``parts`` parts (the session's shuffle
    partitions by default), each numbered in order, in turns; so numbers are
    dense as far as the parts are even. The same values get the same numbers
    whenever and wherever they are computed.

    ``known``: an earlier result; its numbers stay and new values follow after
    its highest, so bitmaps that were built on it can be merged."""
    n = parts or int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = ids.select(F.col(column).alias(ID)).where(F.col(ID).isNotNull()).distinct()
    after = F.lit(0)
    if known is not None:
        found = found.join(known.select(ID), ID, "left_anti")
        found = found.withColumn("_after", known.agg(F.coalesce(F.max(NUMBER), F.lit(0))).scalar())
        after = F.col("_after")
    found = found.withColumn("_part", F.pmod(F.xxhash64(ID), F.lit(n)))
    row = F.row_number().over(Window.partitionBy("_part").orderBy(ID)).cast("long")
    numbered = found.select(ID, (after + (row - 1) * F.lit(n) + F.col("_part") + F.lit(1)).cast("long").alias(NUMBER))
    return numbered if known is None else known.select(ID, NUMBER).unionByName(numbered)


def distinct_bitmaps(df: DataFrame, dims: Sequence[str], entity: str, numbers: DataFrame | None = None) -> DataFrame:
    """``dims``, BUCKET, BITMAP: the non-null ids of ``entity`` in each group.
    ``numbers``: their ``dense_ids``; without it ids are taken as they are
    (any long, but for the least), which suits ids that are dense already.

    Pairs are made distinct first, so a hot id is one row a task, then the at
    most 32,768 ids of a bitmap meet."""
    pairs = df.select(*dims, F.col(entity).alias(ID)).where(F.col(ID).isNotNull()).distinct()
    if numbers is not None:
        pairs = pairs.join(numbers, ID).drop(ID).withColumnRenamed(NUMBER, ID)
    pairs = pairs.select(*dims, F.bitmap_bucket_number(ID).alias(BUCKET), F.bitmap_bit_position(ID).alias("_bit"))
    return (pairs.repartition(*dims, BUCKET).groupBy(*dims, BUCKET)
            .agg(F.bitmap_construct_agg("_bit").alias(BITMAP)))


def merged_bitmaps(bitmaps: DataFrame, dims: Sequence[str] = ()) -> DataFrame:
    """The bitmaps of coarser groups, or of several tables' union."""
    return bitmaps.groupBy(*dims, BUCKET).agg(F.bitmap_or_agg(BITMAP).alias(BITMAP))


def distinct_counts(bitmaps: DataFrame, dims: Sequence[str] = (), out: str = "n") -> DataFrame:
    """COUNT(DISTINCT id) for each group of ``dims``, from bitmaps of finer or
    the same groups. Without ``dims`` one row, 0 if there is none."""
    merged = merged_bitmaps(bitmaps, dims)
    total = F.coalesce(F.sum(F.bitmap_count(BITMAP)), F.lit(0)).cast("long").alias(out)
    return merged.groupBy(*dims).agg(total) if dims else merged.agg(total)
