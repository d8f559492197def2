"""Hot keys: one customer / one campaign holding a third of all rows. The
results must stay exact (checked against plain SQL in DuckDB on the same
rows) and the plans must not route the hot key's raw rows to one task."""

import datetime as dt
import os
import random
import tempfile
from decimal import Decimal

import duckdb
import pytest

from basketry.plans import business as B
from basketry.plans import explore as E
from basketry.plans import marts as V
from basketry.plans.tables import Tables
from basketry.schemas import CAMPAIGNS, CUSTOMERS, EVENTS, PRODUCTS, TRANSACTIONS
from basketry.sources import read_tables

N = 3000
HOT = 7


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(11)
    base = dt.datetime(2022, 1, 1)
    txs, evs = [], []
    for i in range(N):
        cust = HOT if i % 3 == 0 else rnd.randint(1, 400)
        refund = 1 if rnd.random() < 0.05 else 0
        rev = Decimal(rnd.randint(100, 100000)) / 100
        txs.append((i, base + dt.timedelta(days=rnd.randint(0, 700), hours=rnd.randint(0, 23)),
                    cust, rnd.randint(1, 50), rnd.randint(1, 4), Decimal(rnd.randint(0, 30)) / 100,
                    -rev if refund else rev, HOT if i % 3 == 0 else rnd.choice([None, 1, 2, 3]),
                    refund))
        evs.append((i, base + dt.timedelta(minutes=i), cust, i // 5,
                    rnd.choice(["view", "click", "add_to_cart", "purchase", "bounce"]),
                    rnd.randint(1, 50), rnd.choice(["mobile", None]), "Email",
                    HOT if i % 3 == 0 else None, "home"))
    cus = [(c, dt.date(2020, 1 + c % 12, 1), "BR", 18 + c % 60, "F", ["Gold", "Silver"][c % 2])
           for c in range(1, 401)]
    prs = [(p, ["A", "B"][p % 2], "X", Decimal("10.00"), dt.date(2020, 1, 1), p % 2)
           for p in range(1, 51)]
    cas = [(c, "Email", "Retention", dt.date(2020, 1, 1), dt.date(2020, 2, 1), "All",
            Decimal("0.050")) for c in [1, 2, 3, HOT]]
    d = tempfile.mkdtemp(prefix="basketry-skew-")
    frames = {"customers": (cus, CUSTOMERS), "products": (prs, PRODUCTS),
              "campaigns": (cas, CAMPAIGNS), "events": (evs, EVENTS),
              "transactions": (txs, TRANSACTIONS)}
    paths = {}
    for name, (rows, schema) in frames.items():
        paths[name] = os.path.join(d, name)
        spark.createDataFrame(rows, schema).repartition(6).write.parquet(paths[name])
    return Tables.read(spark, paths), paths


def duck_rows(paths, sql):
    con = duckdb.connect()
    for name, p in paths.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p}/*.parquet')")
    con.execute("""CREATE VIEW tx AS SELECT *, CASE WHEN refund_flag = 0 THEN gross_revenue
                   ELSE abs(gross_revenue) END AS rev FROM transactions
                   WHERE product_id IS NOT NULL""")
    return con.execute(sql).fetchall()


def test_hot_customer_second_purchase_gap(skewed):
    t, paths = skewed
    got = sorted((r.customer_id, r.days_to_second_purchase)
                 for r in B.second_purchase_gaps(t).collect())
    want = sorted(duck_rows(paths, """
        SELECT customer_id, date_diff('day', CAST(list_sort(list("timestamp"))[1] AS DATE),
                                             CAST(list_sort(list("timestamp"))[2] AS DATE))
        FROM tx WHERE refund_flag = 0 AND customer_id IS NOT NULL
        GROUP BY customer_id HAVING count(*) >= 2"""))
    assert got == want


def test_hot_customer_rfm_exact(skewed):
    t, paths = skewed
    got = sorted((r.customer_id, r.r_score, r.f_score, r.m_score)
                 for r in V.rfm_segments(t).collect())
    want = sorted(duck_rows(paths, """
        WITH b AS (SELECT customer_id,
                          date_diff('day', CAST(max("timestamp") AS DATE), DATE '2023-12-31') rec,
                          count(*) f, round(sum(rev), 2) m
                   FROM tx WHERE refund_flag = 0 GROUP BY customer_id)
        SELECT customer_id,
               ntile(4) OVER (ORDER BY rec DESC, customer_id),
               ntile(4) OVER (ORDER BY f, customer_id),
               ntile(4) OVER (ORDER BY m, customer_id)
        FROM b"""))
    assert got == want


def test_hot_campaign_channel_and_objective(skewed):
    t, paths = skewed
    got = {r.channel: (r.total_transactions, r.net_revenue) for r in B.channel_performance(t).collect()}
    want = {c: (n, float(v)) for c, n, v in duck_rows(paths, """
        SELECT c.channel, count(DISTINCT t.transaction_id),
               round(sum(CASE WHEN t.refund_flag = 0 THEN t.rev ELSE 0 END), 2)
        FROM tx t JOIN campaigns c ON t.campaign_id = c.campaign_id GROUP BY c.channel""")}
    assert got == want
    conv = {r.campaign_id: (r.exposed_customers, r.converted_customers)
            for r in B.uplift_vs_conversion_points(t).collect()}
    want_conv = {c: (e, p) for c, e, p in duck_rows(paths, """
        SELECT campaign_id, count(DISTINCT customer_id),
               count(DISTINCT CASE WHEN event_type = 'purchase' THEN customer_id END)
        FROM (SELECT * FROM events WHERE NOT (event_type IN ('purchase','add_to_cart')
                                              AND product_id IS NULL))
        WHERE campaign_id IN (SELECT campaign_id FROM campaigns) GROUP BY campaign_id""")}
    assert conv == want_conv


def test_hot_customer_tier_join(skewed):
    t, paths = skewed
    got = {r.loyalty_tier: (r.total_customers, r.total_transactions)
           for r in E.loyalty_behavior(t).collect()}
    want = {tier: (c, n) for tier, c, n in duck_rows(paths, """
        SELECT c.loyalty_tier, count(DISTINCT t.customer_id), count(t.transaction_id)
        FROM tx t JOIN customers c ON t.customer_id = c.customer_id
        WHERE t.refund_flag = 0 GROUP BY c.loyalty_tier""")}
    assert got == want


def test_hot_key_never_reaches_a_window_unlimited(skewed):
    """The per-customer window runs only after a per-task top-2 limit."""
    t, _ = skewed
    plan = B.second_purchase_gaps(t)._jdf.queryExecution().executedPlan().toString()
    exchange_at = plan.find("Exchange hashpartitioning(customer_id")
    partial_at = plan.find("row_number(), 2, Partial")
    final_at = plan.find("row_number(), 2, Final")
    # printed top-down: Final above the shuffle, Partial (per map task) below it
    assert 0 <= final_at < exchange_at < partial_at


def test_sales_filter_and_pruning_reach_the_scan(spark, skewed):
    _, paths = skewed
    t = Tables.read(spark, paths)
    plan = B.north_star(t)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(product_id), IsNotNull(refund_flag), EqualTo(refund_flag,0)]" \
        in plan or ("EqualTo(refund_flag,0)" in plan and "IsNotNull(product_id)" in plan)
    schema = plan[plan.find("ReadSchema: struct<"):].split(">")[0]
    assert "gross_revenue" in schema and "quantity" not in schema and "campaign_id" not in schema
    assert read_tables  # S2 reader used by Tables.read


def test_revenue_tiles_and_percentiles_on_plain_scans(skewed):
    """B03 / E01 over tables read straight from files."""
    t, paths = skewed
    got = {r.segment: (r.total_transactions, r.total_revenue)
           for r in B.revenue_concentration(t).collect()}
    want = {seg: (n, float(v)) for seg, n, v in duck_rows(paths, """
        SELECT CASE WHEN tile = 20 THEN 'Top 5%' ELSE 'Bottom 95%' END, count(*), round(sum(rev), 2)
        FROM (SELECT rev, ntile(20) OVER (ORDER BY rev, transaction_id) AS tile
              FROM tx WHERE refund_flag = 0)
        GROUP BY 1""")}
    assert got == want
    e = E.revenue_distribution(t).first()
    p50, p95 = duck_rows(paths, """SELECT round(quantile_cont(CAST(rev AS DOUBLE), 0.5), 2),
                                          round(quantile_cont(CAST(rev AS DOUBLE), 0.95), 2)
                                   FROM tx WHERE refund_flag = 0""")[0]
    assert (e.p50_median, e.p95) == (p50, p95)
