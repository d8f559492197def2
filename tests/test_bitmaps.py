"""Exact distinct counts from bitmaps equal countDistinct."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketry.operators.bitmaps import NUMBER, dense_ids, distinct_bitmaps, distinct_counts, merged_bitmaps

SCHEMA = "g string, h int, id long"


def expected(rows, by):
    out: dict = {}
    for g, h, i in rows:
        k = tuple({"g": g, "h": h}[c] for c in by)
        out.setdefault(k, set())
        if i is not None:
            out[k].add(i)
    return sorted(((*k, len(v)) for k, v in out.items() if v), key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


IDS = st.one_of(st.none(), st.integers(-3, 3), st.integers(-2**62, 2**62), st.sampled_from([32768, 32769, -32768, 2**63 - 1, -2**63]))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from([0, 1, None]), IDS), max_size=60))
def test_counts_equal_count_distinct(spark, rows):
    """NULL groups and ids, negative and sparse ids, repeated rows."""
    df = spark.createDataFrame(rows + rows[:3], SCHEMA)
    bitmaps = distinct_bitmaps(df, ["g", "h"], "id", dense_ids(df, "id", 3))
    for by in (["g", "h"], ["g"], ["h"], []):
        have = got(distinct_counts(bitmaps, by))
        assert have == (expected(rows, by) if by else [(len({i for *_, i in rows if i is not None}),)])


def test_ids_as_they_are(spark):
    rows = [("a", 0, i) for i in (0, 1, -1, -32767, -32768, -40000, 32768, 32769, 65536, 65537, 2**40)] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(distinct_counts(distinct_bitmaps(df, ["g"], "id"), ["g"])) == [("a", 11)]


def test_numbers_are_dense_and_stable(spark):
    rng = random.Random(4)
    ids = [rng.randrange(-2**62, 2**62) for _ in range(50_000)]
    df = spark.createDataFrame([("a", 0, i) for i in ids + ids[:100] + [None]], SCHEMA).repartition(7)
    numbers = dense_ids(df, "id", 8)
    first = {r._id: r._number for r in numbers.collect()}
    assert set(first) == set(ids) and len(set(first.values())) == len(set(ids))
    assert min(first.values()) >= 1 and max(first.values()) < 1.1 * len(set(ids))
    assert first == {r._id: r._number for r in dense_ids(df.repartition(3), "id", 8).collect()}
    # 50,000 sparse ids fit in two bitmaps
    assert distinct_bitmaps(df, ["g"], "id", numbers).count() == 2


def test_deltas_are_merged(spark):
    rng = random.Random(6)
    batches = [[(rng.choice("ab"), rng.choice([0, 1]), rng.randrange(-400, 400) * 10**9) for _ in range(500)] for _ in range(3)]
    numbers, stored, seen = None, None, []
    for k, batch in enumerate(batches):
        seen += batch
        df = spark.createDataFrame(batch, SCHEMA)
        before = {r._id: r[NUMBER] for r in numbers.collect()} if numbers is not None else {}
        numbers = spark.createDataFrame(dense_ids(df, "id", 4, known=numbers).collect())
        after = {r._id: r[NUMBER] for r in numbers.collect()}
        assert all(after[i] == n for i, n in before.items()) and len(set(after.values())) == len(after)
        new = distinct_bitmaps(df, ["g", "h"], "id", numbers)
        stored = new if stored is None else merged_bitmaps(stored.unionByName(new), ["g", "h"])
        for by in (["g", "h"], ["g"]):
            assert got(distinct_counts(stored, by)) == expected(seen, by)


@pytest.mark.parametrize("hot", [True])
def test_a_hot_id_is_one_row(spark, hot):
    df = spark.range(30_000).select(F.lit("a").alias("g"), F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("id"))
    assert got(distinct_counts(distinct_bitmaps(df, ["g"], "id"), ["g"])) == [("a", df.select("id").distinct().count())]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    b = distinct_bitmaps(df, ["g"], "id", dense_ids(df, "id"))
    assert got(distinct_counts(b, ["g"])) == [] and got(distinct_counts(b)) == [(0,)]
