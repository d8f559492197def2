"""Queries answered from the stored lattice equal those over the facts."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from basketry.plans.lattice import KEYS, MEASURES, Lattice, merge_into_lattice, with_lattice, write_lattice
from basketry.plans.registry import run_entry
from basketry.plans.tables import Tables
from basketry.schemas import CAMPAIGNS, CUSTOMERS, EVENTS, PRODUCTS, TRANSACTIONS

ANSWERED = ["gross_vs_refunds", "discount_impact", "channel_performance", "objective_performance", "category_performance",
            "premium_performance", "category_by_premium", "top_products", "premium_refund_profile", "north_star", "monthly_revenue"]


def transactions(seed, n, start=0):
    """NULLs in every column, repeated and sparse ids, a hot campaign."""
    rng, base = random.Random(seed), dt.datetime(2022, 1, 1)
    def maybe(x):
        return None if rng.random() < 0.04 else x
    return [(maybe((start + i // 2 * 2) * 10**12 - 5), maybe(base + dt.timedelta(days=rng.randint(0, 400))), maybe(rng.randint(-30, 300)),
             maybe(rng.randint(1, 20)), 1, maybe(Decimal(rng.choice([0, 0, 10, 25])) / 100), maybe(Decimal(rng.randint(-9999, 99999)) / 100),
             maybe(7 if i % 3 == 0 else rng.randint(1, 6)), maybe(1 if rng.random() < 0.1 else 0)) for i in range(n)]


def tables(spark, rows):
    products = [(p, ["A", "B", None][p % 3], "X", Decimal("10.00"), dt.date(2020, 1, 1), p % 2) for p in range(1, 19)]
    campaigns = [(c, ["Email", "Social", None][c % 3], ["Retention", None][c % 2], dt.date(2020, 1, 1), dt.date(2020, 2, 1), "All", Decimal("0.050"))
                 for c in (1, 2, 3, 4, 7)] + [(7, "Email", "Acquisition", None, None, None, None)]
    return Tables(customers=spark.createDataFrame([], CUSTOMERS), products=spark.createDataFrame(products, PRODUCTS),
                  campaigns=spark.createDataFrame(campaigns, CAMPAIGNS), events=spark.createDataFrame([], EVENTS),
                  transactions=spark.createDataFrame(rows, TRANSACTIONS).repartition(4))


@pytest.fixture(scope="module")
def lattice(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lattice"))
    t = tables(spark, transactions(1, 900))
    assert write_lattice(spark, t, path) == 1
    return t, path


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("name", ANSWERED)
def test_results_are_unchanged(spark, lattice, name):
    t, path = lattice
    got, want = run_entry(name, with_lattice(spark, t, path)), run_entry(name, t)
    assert got.dtypes == want.dtypes and same(got, want)


@pytest.mark.parametrize("name", ANSWERED)
def test_no_scan_of_the_facts(spark, lattice, name):
    t, path = lattice
    opened = []
    stored = with_lattice(spark, t, path)
    stored._sources["transactions"] = lambda: opened.append(name) or t.transactions
    run_entry(name, stored).collect()
    assert not opened


def test_the_facts_are_scanned_once_for_the_summaries(spark, lattice, tmp_path, monkeypatch):
    """The finest table reads the facts, every other one reads it."""
    import basketry.plans.lattice as module
    t, _ = lattice
    folder = str(tmp_path / "facts")
    t.transactions.write.parquet(folder)
    plain = Tables(customers=t.customers, products=t.products, campaigns=t.campaigns, events=t.events, transactions=spark.read.parquet(folder))
    scans, write = {}, module.write_unpublished
    def counted(frames, path, *a):
        scans.update({n: df._jdf.queryExecution().executedPlan().toString().count(folder) for n, df in frames.items()})
        return write(frames, path, *a)
    monkeypatch.setattr(module, "write_unpublished", counted)
    write_lattice(spark, plain, str(tmp_path / "lattice"))
    assert scans["facts"] == 1 and all(scans[n] == 0 for n in ("products", "campaigns", "months", "discounts"))


def test_the_smallest_table_is_chosen(spark, lattice):
    _, path = lattice
    found = Lattice(spark, path)
    sizes = {n: found.table(n).count() for n in ("facts", "products", "campaigns", "months", "discounts")}
    assert found._now["notes"]["rows"] == sizes
    assert found.smallest(["refund_flag"]).count() == min(v for n, v in sizes.items())
    assert found.smallest(["product_id", "discounted"]).count() == sizes["facts"]
    assert found.smallest(KEYS).columns == [*KEYS, *MEASURES]


def test_a_delta_is_merged(spark, tmp_path):
    path, first, more = str(tmp_path), transactions(2, 300), transactions(3, 200, start=150)
    write_lattice(spark, tables(spark, first), path, "day 1")
    assert merge_into_lattice(spark, path, tables(spark, more), "day 2") == 2
    assert merge_into_lattice(spark, path, tables(spark, more), "day 2") == 2      # a repeated batch
    whole = tables(spark, first + more)
    for name in ANSWERED:
        assert same(run_entry(name, with_lattice(spark, whole, path)), run_entry(name, whole)), name


def test_empty_facts(spark, tmp_path):
    t = tables(spark, [])
    write_lattice(spark, t, str(tmp_path))
    for name in ANSWERED:
        assert same(run_entry(name, with_lattice(spark, t, str(tmp_path))), run_entry(name, t)), name
