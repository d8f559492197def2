"""Top-n of facts joined to a dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame


def top_n_joined(facts: DataFrame, dim: DataFrame, on: str, order: Sequence[Column], n: int,
                 columns: Sequence[str | Column]) -> DataFrame:
    """First ``n`` rows by ``order`` (ending with a unique key) of ``facts``
    INNER JOIN ``dim`` USING ``on``.

    One lazy plan: ``facts`` is an aggregate by ``on``, so it is hashed on
    the join key already and only the dimension moves (or is broadcast, if
    Spark finds it small); the limit is TakeOrderedAndProject, ``n`` rows a
    task.
    """
    return facts.join(dim, on).select(*columns).orderBy(*order).limit(n)
