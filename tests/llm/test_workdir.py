"""Intermediate tables: contents, shuffle files, session settings."""

from pathlib import Path

from pyspark.sql import functions as F

from basketry.llm.workdir import _CLEANUP, saved


def _shuffle_ids(spark) -> set[str]:
    """Numbers of the shuffles that have files on this machine."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = (f for d in blocks.localDirs() for f in Path(d.getPath()).rglob("shuffle_*"))
    return {f.name.split("_")[1] for f in files}


def test_the_write_leaves_no_shuffle_files(spark):
    grouped = spark.range(5000).groupBy((F.col("id") % 97).alias("k")).agg(F.sum("id").alias("total"))
    before = _shuffle_ids(spark)
    table = saved(grouped, "test-shuffles")
    assert _shuffle_ids(spark) <= before
    assert {r.k: r.total for r in table.collect()} == {k: sum(range(k, 5000, 97)) for k in range(97)}


def test_one_frame_can_be_saved_twice_and_read_between(spark):
    grouped = spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count()
    want = sorted(map(tuple, grouped.collect()))
    for _ in range(2):
        assert sorted(map(tuple, saved(grouped, "test-twice").collect())) == want
        assert sorted(map(tuple, grouped.collect())) == want


def test_the_setting_is_given_back(spark):
    before = spark.conf.get(_CLEANUP)
    saved(spark.range(3), "test-setting")
    assert spark.conf.get(_CLEANUP) == before
    spark.conf.set(_CLEANUP, "true")
    try:
        saved(spark.range(3), "test-setting")
        assert spark.conf.get(_CLEANUP) == "true"
    finally:
        spark.conf.set(_CLEANUP, before)
