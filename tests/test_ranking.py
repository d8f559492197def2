"""Distributed exact rank / NTILE / percentile equal Spark's single-partition
built-ins."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from basketry.operators.ranking import global_rank, ntile_labels, percentiles, rows_at_ranks


def _frame(spark, keys):
    return spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, k long")


def _builtin_ntile(df, k, order):
    w = Window.orderBy(order, F.col("id").asc())
    return {r.id: r.t for r in df.select("id", F.ntile(k).over(w).alias("t")).collect()}


def _ours(df, k, order, narrow=None):
    desc = "DESC" in str(order)
    out = ntile_labels(df.repartition(5), k, {"t": ("k", desc)}, "id", narrow=narrow)
    return {r.id: r.t for r in out.select("id", "t").collect()}


def test_ntile_fewer_rows_than_tiles(spark):
    df = _frame(spark, [5, 1, 3])
    assert _ours(df, 4, F.col("k").asc()) == _builtin_ntile(df, 4, F.col("k").asc())


def test_ntile_uneven_split(spark):
    df = _frame(spark, list(range(10)))
    got = _ours(df, 4, F.col("k").asc())
    assert got == _builtin_ntile(df, 4, F.col("k").asc())
    assert sorted(got.values()) == [1, 1, 1, 2, 2, 2, 3, 3, 4, 4]


def test_ntile_all_keys_equal_uses_tie_break(spark):
    df = _frame(spark, [7] * 9)
    got = _ours(df, 4, F.col("k").desc())
    assert got == _builtin_ntile(df, 4, F.col("k").desc())


def test_ntile_hot_key_spread_over_partitions(spark):
    # one value holds most rows; ranking on (key, id) still splits it
    keys = [1] * 700 + list(range(2, 302))
    random.Random(1).shuffle(keys)
    df = _frame(spark, keys)
    assert _ours(df, 20, F.col("k").asc()) == _builtin_ntile(df, 20, F.col("k").asc())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = global_rank(df, [F.col("k").asc()], ["id"]).withColumn("p", F.spark_partition_id())
        hot = placed.filter("k = 1").select("p").distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert hot > 1


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(min_value=-5, max_value=5), min_size=0, max_size=60),
       st.integers(min_value=1, max_value=9), st.booleans())
def test_ntile_property(spark, keys, k, desc):
    df = _frame(spark, keys)
    order = F.col("k").desc() if desc else F.col("k").asc()
    assert _ours(df, k, order) == _builtin_ntile(df, k, order)


def test_global_rank_is_a_permutation(spark):
    df = _frame(spark, [random.Random(3).randint(0, 50) for _ in range(500)])
    ranked = global_rank(df, [F.col("k").asc()], ["id"]).collect()
    assert sorted(r._rank for r in ranked) == list(range(500))
    assert {r._total for r in ranked} == {500}
    by_rank = sorted(ranked, key=lambda r: r._rank)
    assert [(r.k, r.id) for r in by_rank] == sorted((r.k, r.id) for r in ranked)


def _check_percentiles(spark, vals, ps, narrow=None, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, v double").withColumn("v", F.col("v").cast(kind))
    got = percentiles(df, "v", ps, "id", narrow=narrow).first().asDict()
    ref = df.agg(*[F.percentile(F.col("v").cast("double"), p).alias(n) for n, p in ps.items()]).first().asDict()
    assert list(got) == list(ps)
    for n in ps:
        assert abs(got[n] - ref[n]) < 1e-9, (n, got[n], ref[n])


PS = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p0": 0.0, "p100": 1.0}


@pytest.mark.parametrize("kind", ["double", "decimal(18,2)"])
@pytest.mark.parametrize("narrow", [False, True])
def test_percentiles_match_builtin(spark, narrow, kind):
    rnd = random.Random(7)
    _check_percentiles(spark, [round(rnd.uniform(-100, 1000), 2) for _ in range(2999)] + [None] * 5, PS, narrow, kind)


@pytest.mark.parametrize("narrow", [False, True])
def test_percentiles_with_a_hot_value(spark, narrow):
    """A value holding a third of the rows."""
    rnd = random.Random(9)
    vals = [42.0] * 400 + [round(rnd.lognormvariate(3, 2), 2) for _ in range(800)] + [None] * 7
    _check_percentiles(spark, vals, PS, narrow)
    _check_percentiles(spark, vals, PS, narrow, "decimal(18,2)")


def gathered(df, keys, ranks, narrow, monkeypatch):
    """Rows that the last pass keeps."""
    import basketry.operators.ranking as ranking
    select = type(df).selectExpr
    sizes = []
    def watched(self, *columns):
        if "_r0" in self.columns and not sizes:
            sizes.append(select(self, "size(_r0) AS n").first().n)
        return select(self, *columns)
    monkeypatch.setattr(type(df), "selectExpr", watched)
    ranking.rows_at_ranks(df, keys, "id", ranks, narrow=narrow)
    monkeypatch.undo()
    return sizes[0]


def test_what_is_gathered_is_bounded_by_the_sketch(spark, monkeypatch):
    """A third of 300,000 rows share a value; neither it nor the rest is
    gathered for a rank inside it."""
    n = 300_000
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 1000).alias("k"))
    def ranks(rows, nulls):
        return [f"cast({rows} * {f} as bigint)" for f in (0.1, 0.25, 0.5, 0.9)]
    for narrow, most in ((False, 0.02), (True, 0.001)):
        assert 0 < gathered(df, {"x": ("k", False)}, {"x": ranks}, narrow, monkeypatch) < 4 * most * n
        got = rows_at_ranks(df, {"x": ("k", False)}, "id", {"x": ranks}, narrow=narrow).first()["x"]
        rows = sorted((7 if i % 3 == 0 else i % 1000, i) for i in range(n))
        assert [(r["v"], r["t"]) for r in got] == [rows[int(n * f)] for f in (0.1, 0.25, 0.5, 0.9)]


def test_many_nulls_are_cut_by_the_tie(spark):
    df = spark.range(60_000).select("id", F.when(F.col("id") % 5 == 0, F.col("id") % 97).alias("k"))
    for desc in (False, True):
        got = ntile_labels(df, 8, {"t": ("k", desc)}, "id").groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a")).collect()
        order = F.col("k").desc_nulls_last() if desc else F.col("k").asc_nulls_first()
        want = df.select("id", F.ntile(8).over(Window.orderBy(order, "id")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a")).collect()
        assert {tuple(r) for r in got} == {tuple(r) for r in want}


def test_a_missed_bracket_is_widened_or_raises(spark, monkeypatch):
    """With no margin the sketch's brackets miss: the narrowing pass takes the
    rest of that side, and without it nothing wrong comes back."""
    import basketry.operators.ranking as ranking
    df = spark.range(50_000).select("id", (F.col("id") * 7919 % 50_000).alias("k"))
    bracket = ranking._bracket
    first = []
    def shifted(sketch, rank, n):
        if len(first) < 2:             # the first pass looks 2,000 ranks too far
            first.append(1)
            return bracket(sketch, f"({rank} + 2000)", n)
        return bracket(sketch, rank, n)
    monkeypatch.setattr(ranking, "_bracket", shifted)
    def ranks(rows, nulls):
        return [f"cast({rows} * 0.4 as bigint)"]
    got = rows_at_ranks(df, {"x": ("k", False)}, "id", {"x": ranks}, narrow=True).first()["x"]
    assert got[0]["v"] == 20_000
    first.clear()
    with pytest.raises(Exception, match="misses its rank"):
        rows_at_ranks(df, {"x": ("k", False)}, "id", {"x": ranks}, narrow=False).collect()


def test_percentile_small_and_empty(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 10.0), (4, 11.0)], "id long, v double")
    assert percentiles(df, "v", {"p25": 0.25, "p50": 0.5}, "id").first().asDict() == {"p25": 1.75, "p50": 6.0}
    for narrow in (False, True):
        assert percentiles(df.limit(0), "v", {"p50": 0.5}, "id", narrow=narrow).first().asDict() == {"p50": None}
        assert percentiles(df.where("id = 1").withColumn("v", F.lit(None).cast("double")), "v", {"p50": 0.5}, "id", narrow=narrow).first().asDict() == {"p50": None}


def test_building_a_ranking_starts_no_job(spark):
    """Only the listing of the input runs when the frame is built."""
    sc = spark.sparkContext
    df = _frame(spark, list(range(500)))
    sc.setJobGroup("ranking-build", "")
    try:
        labels = ntile_labels(df, 4, {"t": ("k", False)}, "id")
        percentiles(df, "k", PS, "id")
        assert not sc.statusTracker().getJobIdsForGroup("ranking-build")
        labels.collect()
        assert 0 < len(sc.statusTracker().getJobIdsForGroup("ranking-build"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(min_value=-300, max_value=300)), min_size=0, max_size=120),
       st.integers(min_value=1, max_value=9), st.booleans(), st.booleans())
def test_ntile_with_nulls_property(spark, keys, k, desc, narrow):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(keys)], "id long, k long")
    order = F.col("k").desc_nulls_last() if desc else F.col("k").asc_nulls_first()
    assert _ours(df, k, order, narrow) == _builtin_ntile(df, k, order)


def test_ntile_of_several_keys_at_once_and_a_null_tie(spark):
    rnd = random.Random(2)
    rows = [(None if i == 0 else i, rnd.randint(0, 9), round(rnd.random(), 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k long, v double")
    got = ntile_labels(df, 4, {"a": ("k", True), "b": ("v", False)}, "id")
    want = df.select("id", F.ntile(4).over(Window.orderBy(F.col("k").desc(), "id")).alias("a"),
                     F.ntile(4).over(Window.orderBy("v", "id")).alias("b"))
    assert {tuple(r) for r in got.select("id", "a", "b").collect()} == {tuple(r) for r in want.collect()}


def test_rows_at_ranks(spark):
    df = _frame(spark, [random.Random(3).randint(0, 50) for _ in range(500)])
    rows = sorted((r.k, r.id) for r in df.collect())
    wanted = [0, 7, 250, 499, 500, -1]
    got = rows_at_ranks(df, {"x": ("k", False)}, "id", {"x": lambda *_: [str(r) for r in wanted]}).first()["x"]
    assert [r and (r["v"], r["t"]) for r in got] == [rows[r] if 0 <= r < 500 else None for r in wanted]


def test_keys_that_have_no_order_value_are_refused(spark):
    with pytest.raises(TypeError):
        ntile_labels(spark.createDataFrame([("a", 1)], "k string, id long"), 4, {"t": ("k", False)}, "id")
