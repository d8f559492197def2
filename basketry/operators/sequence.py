"""Order-based operators: gap between the a-th and b-th event of an entity,
and period-over-period change on a small per-period aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.scalar import days_between


def nth_event_gap(df: DataFrame, key: str, ts: str, a: int = 1, b: int = 2,
                  out: str = "days_to_second_purchase") -> DataFrame:
    """Per ``key`` with at least ``b`` events: days from its ``a``-th to its
    ``b``-th event by ``ts``.

    ``row_number() <= b`` is planned as a WindowGroupLimit, so each map task
    keeps at most ``b`` rows per key before the shuffle: a key holding a
    third of all rows still sends only ``b`` rows per task. The a-th / b-th
    timestamps are then picked with a conditional max instead of a
    self-join. Equal timestamps give the same gap whichever row is ranked
    first.
    """
    w = Window.partitionBy(key).orderBy(F.col(ts).asc())
    firsts = (df.filter(F.col(key).isNotNull())
              .select(key, ts, F.row_number().over(w).alias("_rn"))
              .filter(F.col("_rn") <= b))
    pair = firsts.groupBy(key).agg(
        F.max(F.when(F.col("_rn") == a, F.col(ts))).alias("_ta"),
        F.max(F.when(F.col("_rn") == b, F.col(ts))).alias("_tb"))
    return (pair.filter(F.col("_tb").isNotNull())
            .select(key, days_between("_ta", "_tb").alias(out)))


def with_previous(df: DataFrame, period: str, value: str, out: str) -> DataFrame:
    """``out`` = LAG(value) OVER (ORDER BY period): the previous existing
    period, gaps are not filled. For per-period aggregates (few rows)."""
    return df.withColumn(out, F.lag(value).over(Window.orderBy(F.col(period).asc_nulls_first())))
