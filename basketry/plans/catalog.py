"""Entry catalogue: id -> operator. Modules register with ``@entry``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Entry:
    key: str       # stable id, e.g. "B19"
    name: str      # query name used by the driver, e.g. "rfm_summary"
    fn: Callable[..., DataFrame]


CATALOG: dict[str, Entry] = {}


def entry(key: str, name: str):
    def register(fn):
        CATALOG[name] = Entry(key, name, fn)
        return fn
    return register
