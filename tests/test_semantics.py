"""Semantics on tiny inline tables: cleaning rules, NULL handling, date
gaps, bands, lag, left-join cohorts, rounding and zero denominators; plus
cross-query invariants on the fixture data."""

import datetime as dt
from decimal import Decimal

import pytest

from basketry import schemas
from basketry.plans import business as B
from basketry.plans import explore as E
from basketry.plans import marts as V
from basketry.plans.tables import Tables

D = Decimal
T = dt.datetime


def mk(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def tables(spark, customers=(), products=(), campaigns=(), events=(), transactions=(),
           as_of="2023-12-31"):
    return Tables(mk(spark, schemas.CUSTOMERS, list(customers)),
                  mk(spark, schemas.PRODUCTS, list(products)),
                  mk(spark, schemas.CAMPAIGNS, list(campaigns)),
                  mk(spark, schemas.EVENTS, list(events)),
                  mk(spark, schemas.TRANSACTIONS, list(transactions)), as_of=as_of)


def tx(tid, ts, cust, rev, refund=0, product=1, qty=1, disc="0.00", campaign=None):
    return (tid, ts, cust, product, qty, D(disc), None if rev is None else D(str(rev)),
            campaign, refund)


def ev(eid, ts, cust, etype, product=1, device="mobile", source="Email", campaign=None,
       session=1):
    return (eid, ts, cust, session, etype, product, device, source, campaign, "home")


def test_refund_sign_and_null_flag(spark):
    t = tables(spark, transactions=[tx(1, T(2023, 1, 1), 1, 10, 0), tx(2, T(2023, 1, 1), 1, -10, 1),
                                    tx(3, T(2023, 1, 1), 1, -10, None), tx(4, T(2023, 1, 1), 1, 10, 1),
                                    tx(5, T(2023, 1, 1), 1, 10, 0, product=None)])
    rows = {r.transaction_id: r for r in t.tx.collect()}
    assert 5 not in rows                                   # no product -> dropped
    assert rows[1].gross_revenue_clean == D("10.00")
    assert rows[2].gross_revenue_clean == D("10.00")       # refund -> absolute value
    assert rows[3].gross_revenue_clean == D("10.00")       # NULL flag -> absolute branch
    assert rows[2].gross_revenue_raw == D("-10.00")
    g = B.gross_vs_refunds(t).first()
    assert g.total_refund_transactions == 2                # NULL flag is neither 0 nor 1
    assert g.gross_revenue == 40.0 and g.total_refunded == 20.0
    assert g.refund_revenue_pct == 200.0                   # refunded / *sales* revenue


def test_event_cleaning_three_valued_logic(spark):
    evs = [ev(1, T(2023, 1, 1), 1, "purchase", 5), ev(2, T(2023, 1, 1), 1, "purchase", None),
           ev(3, T(2023, 1, 1), 1, "view", None), ev(4, T(2023, 1, 1), 1, None, None),
           ev(5, T(2023, 1, 1), 1, None, 3), ev(6, T(2023, 1, 1), 1, "add_to_cart", None, device=None)]
    got = {r.event_id: r for r in tables(spark, events=evs).ev.collect()}
    assert sorted(got) == [1, 3, 5]                        # NULL type + NULL product dropped
    devs = tables(spark, events=[ev(7, T(2023, 1, 1), 1, "view", None, device=None)]).ev.first()
    assert devs.device_type == "Unknown"


def test_days_to_second_purchase_counts_midnights(spark):
    t = tables(spark, transactions=[tx(1, T(2023, 1, 1, 23, 59), 1, 5), tx(2, T(2023, 1, 2, 0, 1), 1, 5),
                                    tx(3, T(2023, 3, 1), 1, 5), tx(4, T(2023, 1, 1), 2, 5)])
    gaps = {r.customer_id: r.days_to_second_purchase for r in B.second_purchase_gaps(t).collect()}
    assert gaps == {1: 1}                                  # 23:59 -> 00:01 is one day
    s = B.days_to_second_stats(t).first()
    assert (s.avg_days, s.min_days, s.max_days, s.median_days) == (1.0, 1, 1, 1.0)


def test_equal_timestamps_give_zero_gap(spark):
    t = tables(spark, transactions=[tx(1, T(2023, 1, 1), 1, 5), tx(2, T(2023, 1, 1), 1, 5),
                                    tx(3, T(2023, 1, 9), 1, 5)])
    assert [r.days_to_second_purchase for r in B.second_purchase_gaps(t).collect()] == [0]


def test_revenue_percentiles(spark):
    t = tables(spark, transactions=[tx(i + 1, T(2023, 1, 1), 1, v) for i, v in enumerate([1, 2, 10, 11])])
    r = E.revenue_distribution(t).first()
    assert (r.p25, r.p50_median, r.total_transactions) == (1.75, 6.0, 4)
    assert r.stddev_revenue == 5.23 and r.avg_revenue == 6.0


def test_pair_key_collision_kept(spark):
    evs = [ev(1, T(2023, 1, 1), 11, "view", session=1), ev(2, T(2023, 1, 1), 1, "view", session=11)]
    r = E.session_identity_check(tables(spark, events=evs)).first()
    assert (r.unique_sessions, r.unique_customers, r.unique_combinations) == (2, 2, 1)


def test_age_bands(spark):
    ages = [17, 18, 24, 25, 54, 55, None]
    cus = [(i, dt.date(2020, 1, 1), "BR", a, "F", "Gold") for i, a in enumerate(ages)]
    got = {r.customer_id: r.age_group for r in V.customer_summary(tables(spark, customers=cus)).collect()}
    assert [got[i] for i in range(len(ages))] == ["55+", "18-24", "18-24", "25-34", "45-54", "55+", "55+"]


def test_lag_takes_previous_existing_month(spark):
    t = tables(spark, transactions=[tx(1, T(2023, 1, 5), 1, 100), tx(2, T(2023, 3, 5), 1, 150)])
    rows = {r.month: r for r in B.mom_growth(t).collect()}
    assert rows["2023-03"].prev_month_revenue == 100.0
    assert rows["2023-03"].mom_growth_pct == 50.0
    assert rows["2023-01"].prev_month_revenue is None and rows["2023-01"].mom_growth_pct is None


def test_cohort_left_join_keeps_non_buyers(spark):
    cus = [(1, dt.date(2021, 5, 2), "BR", 30, "M", "Gold"), (2, dt.date(2021, 6, 2), "BR", 30, "M", "Gold")]
    t = tables(spark, customers=cus, transactions=[tx(1, T(2023, 1, 1), 2, -50, 1)])
    rows = {r.customer_id: r for r in V.cohort_analysis(t).collect()}
    assert rows[2].total_purchases == 0 and rows[2].total_revenue is None
    assert rows[2].signup_cohort == "2021-06"
    summ = {r.customer_id: r for r in V.customer_summary(t).collect()}
    assert summ[2].total_revenue == 0.0 and summ[2].never_purchased == 1 and summ[2].lifespan_days == 0


def test_rounding_half_away_from_zero(spark):
    from pyspark.sql import functions as F

    from basketry.functions.scalar import round_half_up
    df = spark.createDataFrame([(1.005,), (-1.005,), (2.675,), (0.125,)], "x double")
    got = [r.r for r in df.select(round_half_up(F.col("x")).alias("r")).collect()]
    assert got == [1.01, -1.01, 2.68, 0.13]


def test_zero_denominators_are_null(spark):
    evs = [ev(1, T(2023, 1, 1), 1, "click"), ev(2, T(2023, 1, 1), 2, "purchase")]
    f = B.funnel(tables(spark, events=evs)).first()
    assert f.view_stage == 0 and f.view_to_click_pct is None and f.overall_conversion_pct is None
    r = B.bounce_recovery(tables(spark, events=evs)).first()
    assert r.total_bounced == 0 and r.bounce_recovery_rate_pct is None


def test_funnel_on_no_events(spark):
    f = B.funnel(tables(spark)).first()
    assert (f.view_stage, f.purchase_stage) == (0, 0)


def test_single_row_stddev_is_null(spark):
    r = E.revenue_distribution(tables(spark, transactions=[tx(1, T(2023, 1, 1), 1, 3)])).first()
    assert r.stddev_revenue is None and r.p95 == 3.0


def test_rfm_labels_and_tie_break(spark):
    txs = [tx(i, T(2023, 12, 1 + (i % 20)), i, 10 * i) for i in range(1, 9)]
    seg = {r.customer_id: r for r in V.rfm_segments(tables(spark, transactions=txs)).collect()}
    assert {r.f_score for r in seg.values()} == {1, 2, 3, 4}   # all frequency 1: tie by id
    assert [seg[i].f_score for i in range(1, 9)] == [1, 1, 2, 2, 3, 3, 4, 4]
    for r in seg.values():
        total = r.r_score + r.f_score + r.m_score
        assert r.rfm_total == total
        want = "Champions" if total >= 10 else "Loyal" if total >= 7 else \
            "Potential" if total >= 5 else "At Risk"
        assert r.rfm_segment == want


# ---- invariants on the driver fixture ----------------------------------------

def test_invariants(spark, small_tables):
    t = small_tables
    n_customers = t.cu.count()
    assert V.cohort_analysis(t).count() == n_customers
    assert V.customer_summary(t).count() == n_customers
    for df, col in [(E.quantity_distribution(t), "pct"), (E.purchase_recurrence(t), "pct"),
                    (B.revenue_by_frequency(t), "pct_of_total_revenue"),
                    (B.rfm_summary(t), "pct_of_revenue")]:
        assert sum(r[col] for r in df.collect()) == pytest.approx(100.0, abs=0.1)
    rfm = B.rfm_summary(t).collect()
    assert sum(r.total_customers for r in rfm) == B.retention_rate(t).first().total_customers
    flags = V.funnel_customers(t).filter("customer_id IS NOT NULL").groupBy().sum().first()
    f = B.funnel(t).first()
    assert (flags["sum(reached_view)"], flags["sum(reached_purchase)"]) == (f.view_stage, f.purchase_stage)
    returning = B.retention_rate(t).first().returning_buyers
    assert sum(r.total_customers for r in V.days_to_second_purchase(t).collect()) == returning


def test_fixture_probe_values(spark):
    """Counts recorded for the sf0.01 fixture mapping."""
    from conftest import SF_MEDIUM
    t = Tables.from_fixtures(spark, SF_MEDIUM)
    segs = {r.rfm_segment: r.total_customers for r in B.rfm_summary(t).collect()}
    assert segs == {"Champions": 403, "Loyal": 541, "Potential": 282, "At Risk": 271}
    conc = {r.segment: r.total_transactions for r in B.revenue_concentration(t).collect()}
    assert conc == {"Top 5%": 487, "Bottom 95%": 9256}
    bands = {r.purchase_segment: r.total_customers for r in E.purchase_recurrence(t).collect()}
    assert bands == {"1 purchase": 22, "2-3 purchases": 144, "4-5 purchases": 362, "6+ purchases": 969}
    assert B.days_to_second_stats(t).first().median_days == 253.0


def test_top_n_joined_retries_when_candidates_miss_the_dimension(spark):
    from pyspark.sql import functions as F

    from basketry.operators.topn import top_n_joined
    facts = spark.createDataFrame([(i, float(100 - i)) for i in range(1, 41)], "cid long, rev double")
    dim = spark.createDataFrame([(i, f"c{i}") for i in range(13, 41)], "cid long, name string")
    order = [F.col("rev").desc(), F.col("cid").asc()]
    got = [r.cid for r in top_n_joined(facts, dim, "cid", order, 10, ["cid", "name", "rev"]).collect()]
    want = [r.cid for r in facts.join(dim, "cid").orderBy(*order).limit(10).collect()]
    assert sorted(got) == sorted(want) == list(range(13, 23))
    few = top_n_joined(facts.filter("cid <= 3"), dim, "cid", order, 10, ["cid"]).collect()
    assert few == []            # all 3 candidates tried; none in the dimension


def test_funnel_stages_are_independent_counts(spark):
    """Stages count distinct customers per event type, not an ordered
    funnel: more clickers than viewers gives a ratio above 100%."""
    evs = [ev(1, T(2023, 1, 1), 1, "view"), ev(2, T(2023, 1, 1), 2, "click"),
           ev(3, T(2023, 1, 1), 3, "click"), ev(4, T(2023, 1, 1), 3, "purchase")]
    f = B.funnel(tables(spark, events=evs)).first()
    assert (f.view_stage, f.click_stage, f.cart_stage, f.purchase_stage) == (1, 2, 0, 1)
    assert f.view_to_click_pct == 200.0 and f.cart_to_purchase_pct is None
    drops = {r.funnel_step: r for r in B.funnel_dropoff(tables(spark, events=evs)).collect()}
    assert drops["view → click"].dropped == -1 and drops["view → click"].drop_off_pct == -100.0


def test_target_attainment_is_exact_at_the_target(spark):
    """2.9 % of 1000 exposed customers: 29 reach the target, 28 do not, and
    2.996 % does not reach 3 %."""
    import datetime as dt
    from decimal import Decimal

    from basketry.plans.narrative import campaign_target_attainment
    from basketry.plans.tables import Tables
    from basketry.schemas import CAMPAIGNS, CUSTOMERS, EVENTS, PRODUCTS, TRANSACTIONS
    d, ts = dt.date(2022, 1, 1), dt.datetime(2022, 1, 1)
    cases = [(1, Decimal("0.029"), 1000, 29), (2, Decimal("0.029"), 1000, 28), (3, Decimal("0.030"), 2503, 75),
             (4, Decimal("0.030"), 2500, 75), (5, Decimal("0.030"), 2500, 76)]
    campaigns = [(c, "Email", "Retention", d, d, "All", u) for c, u, _, _ in cases]
    events = [(c * 10000 + k, ts, k, k, "purchase" if k < hit else "view", 1, "mobile", "Email", c, "home")
              for c, _, exposed, hit in cases for k in range(exposed)]
    t = Tables(spark.createDataFrame([], CUSTOMERS), spark.createDataFrame([], PRODUCTS),
               spark.createDataFrame(campaigns, CAMPAIGNS), spark.createDataFrame(events, EVENTS),
               spark.createDataFrame([], TRANSACTIONS))
    row = campaign_target_attainment(t).first()
    assert (row.campaigns_evaluated, row.campaigns_met_target) == (5, 3)
