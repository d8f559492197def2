"""Per-entity stage flags and the distinct-entity counts built on them.

``COUNT(DISTINCT CASE WHEN type = x THEN customer END)`` for several ``x``
makes Spark expand every row once per distinct aggregate. Aggregating to
one row per (dimension, customer) with 0/1 flags first and summing the
flags afterwards gives the same counts with two partial-aggregating
shuffles and no row expansion.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.scalar import flag, pct


def stage_flags(events: DataFrame, keys: Sequence[str], stages: Mapping[str, str],
                type_col: str = "event_type") -> DataFrame:
    """One row per ``keys`` with ``MAX(CASE WHEN type = stage THEN 1 ELSE 0
    END)`` for every ``name -> stage`` of ``stages``."""
    return events.groupBy(*keys).agg(
        *[F.max(flag(F.col(type_col) == stage)).alias(name) for name, stage in stages.items()])


def distinct_with_flags(events: DataFrame, dims: Sequence[str], entity: str,
                        stages: Mapping[str, str], type_col: str = "event_type") -> DataFrame:
    """Per ``dims``: ``total`` = COUNT(DISTINCT entity) and, per stage,
    COUNT(DISTINCT CASE WHEN type = stage THEN entity END). NULL entities
    are not counted, as in COUNT(DISTINCT)."""
    per_entity = stage_flags(events.filter(F.col(entity).isNotNull()),
                             [*dims, entity], stages, type_col)
    return per_entity.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.sum(F.col(name)).cast("bigint").alias(name) for name in stages])


def conversion_by(events: DataFrame, dim: str, stage: str = "purchase",
                  type_col: str = "event_type", entity: str = "customer_id") -> DataFrame:
    """Per ``dim``: distinct customers, distinct customers reaching
    ``stage`` and the conversion percentage."""
    counts = distinct_with_flags(events, [dim], entity, {"converted_customers": stage}, type_col)
    return counts.select(
        dim,
        F.col("total").alias("total_customers"),
        F.col("converted_customers"),
        pct(F.col("converted_customers"), F.col("total")).alias("conversion_rate_pct"))
