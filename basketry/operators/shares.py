"""Share of total over an already aggregated frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.scalar import pct


def share_of_total(df: DataFrame, value: str, out: str,
                   within: Sequence[str] = (), n: int = 2) -> DataFrame:
    """``out`` = ROUND(100.0 * value / SUM(value) OVER (PARTITION BY within), n).

    Only for frames that are already grouped (a handful of rows per
    ``within`` group): with no ``within`` the window is one partition.
    """
    w = Window.partitionBy(*within) if within else Window.partitionBy()
    return df.withColumn(out, pct(F.col(value), F.sum(value).over(w), n))
