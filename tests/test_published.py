"""Atomic publishing: what readers see while a publication is written, fails,
or competes with another."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from basketry.sources import (clear_versions, publication, publish, published_versions, read_mart, read_published,
                              write_marts)
from basketry.sources.published import PublishConflict, _Store


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_readers_follow_the_last_publication(spark, tmp_path):
    path = str(tmp_path)
    assert published_versions(spark, path) == []
    with pytest.raises(FileNotFoundError):
        read_published(spark, path, "a")
    assert publish(spark, {"a": spark.range(3), "b": spark.range(1)}, path, {"why": "first"}) == 1
    old = read_published(spark, path, "a")
    assert publish(spark, {"a": spark.range(5)}, path) == 2
    assert read_published(spark, path, "a").count() == 5 and old.count() == 3
    assert read_published(spark, path, "a", version=1).count() == 3
    assert publication(spark, path, 1)["notes"] == {"why": "first"}
    with pytest.raises(KeyError):
        read_published(spark, path, "b")              # a publication is a whole set
    with pytest.raises(FileNotFoundError):
        read_published(spark, path, "a", version=9)


def test_a_failure_in_the_middle_leaves_the_old_marts(spark, tmp_path):
    path = str(tmp_path)
    write_marts({"a": spark.range(3), "b": spark.range(4)}, path)
    broken = spark.range(8).withColumn("id", F.when(F.col("id") == 6, F.raise_error(F.lit("injected"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="injected"):
        write_marts({"a": spark.range(30), "b": broken, "c": spark.range(1)}, path)
    assert published_versions(spark, path) == [1]
    assert read_mart(spark, path, "a").count() == 3 and read_mart(spark, path, "b").count() == 4
    # the next write goes on as if nothing had been
    write_marts({"a": spark.range(30)}, path)
    assert read_mart(spark, path, "a").count() == 30
    assert clear_versions(spark, path, keep=1, unfinished=True) == [1]
    assert len(list((tmp_path / "versions").iterdir())) == 1 and read_mart(spark, path, "a").count() == 30


def test_a_concurrent_reader_never_sees_half(spark, tmp_path):
    """Both tables of each publication hold the same number."""
    path = str(tmp_path)
    def numbered(k):
        return {"a": spark.range(4).select(F.lit(k).alias("k")), "b": spark.range(2).select(F.lit(k).alias("k"))}
    publish(spark, numbered(0), path)
    seen, wrong, done = set(), [], threading.Event()

    def read():
        while not done.is_set():
            try:
                now = publication(spark, path)
                a, b = (spark.read.parquet(now["tables"][n]).collect() for n in ("a", "b"))
            except Exception as e:  # noqa: BLE001
                wrong.append(e)
                return
            ks = {r.k for r in a + b}
            seen.add(min(ks))
            if len(ks) != 1 or len(a) != 4 or len(b) != 2:
                wrong.append((a, b))

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(1, 8):
        publish(spark, numbered(k), path)
        time.sleep(0.05)
    done.set()
    reader.join(60)
    assert not wrong and len(seen) > 1


def test_two_publishers_of_one_number(spark, tmp_path):
    path = str(tmp_path)
    publish(spark, {"a": spark.range(1)}, path)
    publish(spark, {"a": spark.range(2)}, path, after=1)
    with pytest.raises(PublishConflict):
        publish(spark, {"a": spark.range(3)}, path, after=1)
    assert read_published(spark, path, "a").count() == 2


def test_pointers_are_written_whole(spark, tmp_path):
    store = _Store(spark, str(tmp_path))
    store.create("pointers/x", "é" * 1000)
    assert store.read("pointers/x") == "é" * 1000
    with pytest.raises(PublishConflict):
        store.create("pointers/x", "other")
    assert store.names("drafts") == [] and store.read("pointers/x")[0] == "é"


def test_clear_versions_keeps_what_later_ones_name(spark, tmp_path):
    path = str(tmp_path)
    publish(spark, {"log": spark.range(3)}, path)
    for n in range(4):
        now = publication(spark, path)
        publish(spark, {"a": spark.range(n)}, path, kept={"log": now["tables"]["log"]})
    assert clear_versions(spark, path, keep=2) == [1, 2, 3]
    assert published_versions(spark, path) == [4, 5]
    assert read_published(spark, path, "log").count() == 3 and read_published(spark, path, "a").count() == 3
    assert len(list((tmp_path / "versions").iterdir())) == 3
    assert json.loads(next((tmp_path / "pointers").glob("*5.json")).read_text())["tables"].keys() == {"log", "a"}


def test_partitioned_marts(spark, tmp_path):
    df = spark.range(10).withColumn("p", F.col("id") % 2)
    folders = write_marts({"m": df}, str(tmp_path), partition_by={"m": ["p"]})
    assert rows(read_mart(spark, str(tmp_path), "m").where("p = 1").select("id")) == [(1,), (3,), (5,), (7,), (9,)]
    assert spark.read.parquet(folders[0]).count() == 10
