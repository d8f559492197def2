"""Every registered query equals its SQL oracle (DuckDB) exactly."""

import pytest

import __spark_entry__ as se
from conftest import SF_MEDIUM, SF_SMALL
from basketry.plans.registry import ENTRIES
from oracle_check import compare

NAMES = list(ENTRIES)


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(se.oracle_sql()) and set(NAMES) <= set(se.queries())
    assert len(NAMES) == 61


@pytest.mark.parametrize("sf_dir", [SF_SMALL])
def test_all_queries_match_oracle(spark, sf_dir):
    report = compare(spark, sf_dir, NAMES, verbose=False)
    bad = {k: v for k, v in report.items() if v != "OK"}
    assert not bad, bad


@pytest.mark.parametrize("name", ["rfm_segments", "revenue_concentration", "revenue_distribution",
                                  "days_to_second_purchase", "top_customers"])
def test_ranking_queries_match_oracle_sf001(spark, name):
    report = compare(spark, SF_MEDIUM, [name], verbose=False)
    assert report[name] == "OK", report


def test_entry_smoke(spark):
    df = se.entry(spark)
    rows = df.collect()
    assert [f.name for f in df.schema.fields] == [
        "rfm_segment", "total_customers", "total_revenue", "avg_revenue_per_customer",
        "avg_recency_days", "avg_frequency", "pct_of_revenue"]
    assert len(rows) > 0


def test_results_do_not_depend_on_session_settings(spark):
    """ANSI off, AQE off, many shuffle partitions and a non-UTC session zone
    give the same answers (operators use explicit casts, NTZ timestamps)."""
    conf = {"spark.sql.ansi.enabled": "false", "spark.sql.adaptive.enabled": "false",
            "spark.sql.shuffle.partitions": "64", "spark.sql.session.timeZone": "Asia/Kolkata"}
    before = {k: spark.conf.get(k) for k in conf}
    names = ["revenue_distribution", "revenue_concentration", "rfm_summary", "weekday_revenue",
             "hourly_events", "days_to_second_stats", "top_customers", "customer_summary"]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        report = compare(spark, SF_SMALL, names, verbose=False)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert all(v == "OK" for v in report.values()), report
