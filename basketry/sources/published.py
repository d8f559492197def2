"""Atomic publishing of sets of tables.

A publication writes its tables into a folder of its own below
``<path>/versions`` and then creates one small numbered file below
``<path>/pointers`` that names them. Readers follow the highest number. So a
failed write leaves the tables that were published before, a reader sees all
tables of one publication or of another, and two publishers of the same number
cannot both succeed. Folders of older publications stay until
``clear_versions``, as frames that were opened on them are lazy.

Everything goes through Hadoop's file system API, as Spark's own readers and
writers do: any store that Spark reaches will do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


class PublishConflict(RuntimeError):
    """Another publisher took the number in the meantime."""


class _Store:
    def __init__(self, spark: SparkSession, path: str):
        self._hadoop = spark._jvm.org.apache.hadoop
        self._root = self._hadoop.fs.Path(path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = self._hadoop.fs.FileContext.getFileContext(
            self._fs.makeQualified(self._root).toUri(), spark._jsc.hadoopConfiguration())
        self._no_options = spark._sc._gateway.new_array(getattr(self._hadoop.fs, "Options$Rename"), 0)

    def _at(self, name: str):
        return self._fs.makeQualified(self._hadoop.fs.Path(self._root, name))

    def names(self, folder: str) -> list[str]:
        at = self._at(folder)
        if not self._fs.exists(at):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """The whole file at once, and only if there is none of that name."""
        draft, target = self._at(f"drafts/{uuid.uuid4().hex}"), self._at(name)
        out = self._fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.mkdirs(target.getParent())
        try:
            self._context.rename(draft, target, self._no_options)
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(target):
                raise PublishConflict(f"{target.toString()} is there already") from e
            raise

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


def _pointer(number: int) -> str:
    return f"pointers/{number:012d}.json"


def published_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the publications there are, ascending."""
    return [int(n.removesuffix(".json")) for n in _Store(spark, path).names("pointers") if n.endswith(".json")]


def publication(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """What a publication (the latest one) holds: ``version``, ``tables`` (the
    folder of each) and ``notes``."""
    found = published_versions(spark, path)
    if version is None and not found:
        raise FileNotFoundError(f"nothing is published at {path}")
    if version is not None and version not in found:
        raise FileNotFoundError(f"{path} has no version {version}")
    number = found[-1] if version is None else version
    return {"version": number, **json.loads(_Store(spark, path).read(_pointer(number)))}


def write_unpublished(tables: Mapping[str, DataFrame], path: str, partition_by: Mapping[str, list[str]] | None = None) -> dict[str, str]:
    """Write ``tables`` as Parquet into a new folder that no publication names
    yet, for ``publish(kept=...)``; returns the folder of each. Every task
    writes its own files."""
    folder, folders = f"{path.rstrip('/')}/versions/{uuid.uuid4().hex}", {}
    for name, df in tables.items():
        writer = df.write
        if columns := (partition_by or {}).get(name):
            writer = writer.partitionBy(*columns)
        folders[name] = f"{folder}/{name}"
        writer.parquet(folders[name])
    return folders


def publish(spark: SparkSession, tables: Mapping[str, DataFrame], path: str, notes: dict | None = None,
            partition_by: Mapping[str, list[str]] | None = None, kept: Mapping[str, str] | None = None,
            after: int | None = None) -> int:
    """Write ``tables`` as Parquet and publish them, with the folders
    ``kept`` from earlier; returns the number. ``after``: the number that the
    tables were computed from; if it is not the latest any more,
    ``PublishConflict``."""
    store = _Store(spark, path)
    if after is None:
        after = max(published_versions(spark, path), default=0)
    folders = {**(kept or {}), **write_unpublished(tables, path, partition_by)}
    store.create(_pointer(after + 1), json.dumps({"tables": folders, "notes": notes or {}}))
    return after + 1


def read_published(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    """A published table, of the latest publication or of ``version``."""
    tables = publication(spark, path, version)["tables"]
    if name not in tables:
        raise KeyError(f"{name!r} is not among the published tables {sorted(tables)}")
    return spark.read.parquet(tables[name])


def clear_versions(spark: SparkSession, path: str, keep: int = 2, unfinished: bool = False) -> list[int]:
    """Remove all but the last ``keep`` publications and the folders that
    only they name; returns their numbers. ``unfinished``: also folders that
    no publication names, which failed writes leave (and running ones use)."""
    store, found = _Store(spark, path), published_versions(spark, path)
    old, stay = (found[:-keep], found[-keep:]) if keep else (found, [])
    notes = {v: json.loads(store.read(_pointer(v))) for v in found}

    def folders(versions):
        return {f.rsplit("/versions/", 1)[1].split("/")[0] for v in versions for f in notes[v]["tables"].values() if "/versions/" in f}

    used = folders(stay)
    for v in old:
        store.delete(_pointer(v))
    for f in folders(old) - used:
        store.delete(f"versions/{f}")
    if unfinished:
        for f in set(store.names("versions")) - used:
            store.delete(f"versions/{f}")
    return old
