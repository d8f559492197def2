"""Incremental refresh equals a full rebuild after every batch."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from basketry.plans.marts import MARTS
from basketry.plans.refresh import MartStore
from basketry.plans.registry import run_entry
from basketry.plans.tables import Tables
from basketry.schemas import CUSTOMERS, EVENTS, RAW_SCHEMAS, TRANSACTIONS

BASE = dt.datetime(2022, 1, 1)


def transaction(rng, i, customer=None, refund=None):
    refund = rng.choice([0, 0, 0, 1, None]) if refund is None else refund
    rev = Decimal(rng.randint(100, 90000)) / 100
    return (i, rng.choice([None, BASE + dt.timedelta(hours=rng.randint(0, 9000))]) if rng.random() < 0.1 else BASE + dt.timedelta(hours=rng.randint(0, 9000)),
            customer if customer is not None else rng.choice([None, *range(1, 25)]), rng.choice([None, 1, 2, 3]) if rng.random() < 0.2 else 1, 1,
            Decimal("0.10"), None if rng.random() < 0.05 else -rev if refund else rev, None, refund)


def event(rng, i):
    return (i, BASE + dt.timedelta(minutes=i), rng.choice([None, *range(1, 25)]), i // 3,
            rng.choice(["view", "click", "add_to_cart", "purchase", "bounce", None]), rng.choice([None, 5]), None, "Email", None, "home")


def batches(seed):
    """(name, transactions, events): new rows, late refunds and mended
    amounts of earlier ids, a moved customer, ids that repeat in a batch,
    rows without an id, and a batch that says the same again."""
    rng = random.Random(seed)
    first = [transaction(rng, i) for i in range(120)] + [transaction(rng, None) for _ in range(5)] + [transaction(rng, 3), transaction(rng, 3)]
    out = [("day 1", first, [event(rng, i) for i in range(150)])]
    second = [transaction(rng, 200 + i, customer=7 if i % 3 == 0 else None) for i in range(60)]
    second += [(*first[i][:8], 1) for i in range(0, 40, 4)]                    # late refunds
    second += [(*first[50][:2], 9, *first[50][3:])]                            # the sale of another customer
    out.append(("day 2", second, [event(rng, 200 + i) for i in range(40)]))
    out.append(("day 3", [transaction(rng, i, refund=0) for i in (3, 60, 61, 201)] + [transaction(rng, None)], None))
    out.append(("day 3 again", out[2][1][:-1], [event(rng, 100 + i) for i in range(10)]))
    out.append(("day 4", None, [event(rng, 400 + i) for i in range(30)]))
    return out


def customers(seed, n):
    rng = random.Random(seed)
    return [(c, dt.date(2020, 1 + c % 12, 1), "BR", rng.randint(15, 70), "F", rng.choice(["Gold", "Silver"])) for c in range(1, n)]


def newest(applied):
    """Rows of each transaction id from the last batch that has it."""
    last: dict = {}
    for k, rows in enumerate(applied):
        for r in rows:
            if r[0] is not None:
                last[r[0]] = k
    return [r for k, rows in enumerate(applied) for r in rows if r[0] is None or last[r[0]] == k]


def same(a, b):
    return sorted(map(repr, map(tuple, a.collect()))) == sorted(map(repr, map(tuple, b.collect())))


@pytest.mark.parametrize("seed", [1])
def test_refresh_equals_rebuild(spark, tmp_path, seed):
    store = MartStore(spark, str(tmp_path / "store"), "2023-12-31")
    people, applied, events = customers(seed, 25), [], []
    empty = {n: spark.createDataFrame([], RAW_SCHEMAS[n]) for n in ("products", "campaigns")}
    for k, (name, tx, ev) in enumerate(batches(seed)):
        if k == 2:
            people = customers(seed + 1, 28)
        version = store.apply(name, spark.createDataFrame(tx, TRANSACTIONS).repartition(3) if tx else None,
                              spark.createDataFrame(ev, EVENTS) if ev else None,
                              spark.createDataFrame(people, CUSTOMERS) if k in (0, 2) else None)
        assert version == k + 1
        # the same batch again changes nothing
        assert store.apply(name, spark.createDataFrame(tx, TRANSACTIONS) if tx else None) == version
        applied.append(tx or [])
        events += ev or []
        whole = Tables(customers=spark.createDataFrame(people, CUSTOMERS), events=spark.createDataFrame(events, EVENTS),
                       transactions=spark.createDataFrame(newest(applied), TRANSACTIONS), as_of="2023-12-31", **empty)
        for mart in MARTS:
            assert same(store.mart(mart), run_entry(mart, whole)), (name, mart)
        assert same(store.transactions(), whole.transactions)
    assert store.batches() == [name for name, _, _ in batches(seed)]
    assert same(store.mart("customer_summary", 1), store.mart("customer_summary", 1))


def test_a_failed_batch_can_be_applied_again(spark, tmp_path):
    from pyspark.sql import functions as F
    rng = random.Random(3)
    store = MartStore(spark, str(tmp_path / "store"))
    store.apply("a", spark.createDataFrame([transaction(rng, i) for i in range(40)], TRANSACTIONS), customers=spark.createDataFrame(customers(1, 25), CUSTOMERS))
    before = store.mart("customer_summary").collect()
    more = spark.createDataFrame([transaction(rng, 100 + i, refund=0) for i in range(40)], TRANSACTIONS)
    broken = more.withColumn("quantity", F.when(F.col("transaction_id") == 120, F.raise_error(F.lit("injected"))).otherwise(F.col("quantity")).cast("int"))
    with pytest.raises(Exception, match="injected"):
        store.apply("b", broken)
    assert store.batches() == ["a"] and store.mart("customer_summary").collect() == before
    store.apply("b", more)
    assert store.batches() == ["a", "b"] and store.transactions().count() == 80


def test_only_the_batch_and_the_states_are_read_without_retractions(spark, tmp_path):
    """New sales are merged without reading earlier rows' values: the log is
    read for its ids only."""
    rng = random.Random(5)
    store = MartStore(spark, str(tmp_path / "store"))
    store.apply("a", spark.createDataFrame([transaction(rng, i) for i in range(40)], TRANSACTIONS))
    now = store._publication()
    delta = spark.createDataFrame([transaction(rng, 100 + i) for i in range(9)], TRANSACTIONS)
    files = store._merged_sales(now, delta, 1).inputFiles()
    assert any("/sales_state/" in f for f in files) and not any("/log_" in f for f in files)


def test_empty_store(spark, tmp_path):
    store = MartStore(spark, str(tmp_path / "store"))
    assert store.batches() == []
    store.apply("nothing", spark.createDataFrame([], TRANSACTIONS))
    assert all(store.mart(m).count() == 0 for m in MARTS)
