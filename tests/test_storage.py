"""Co-partitioned customer tables, quality counters and CSV ingestion."""

import uuid

import pytest

from basketry.plans.registry import run_entry
from basketry.sources.bucketed import copartitioned, write_copartitioned
from basketry.sources.quality import ingest_csv, observed
from conftest import SF_SMALL

JOINS = ["loyalty_behavior", "age_group_revenue", "loyalty_retention", "top_customers", "cohort_ltv", "cohort_analysis", "customer_summary"]


@pytest.fixture(scope="module")
def stored(spark, small_tables, tmp_path_factory):
    prefix = f"t{uuid.uuid4().hex[:8]}"
    write_copartitioned(small_tables, prefix, 4, str(tmp_path_factory.mktemp("bucketed")))
    yield copartitioned(spark, prefix, small_tables)
    for part in ("customers", "customer_sales", "customer_flags"):
        spark.sql(f"drop table {prefix}_{part}")


@pytest.mark.parametrize("name", JOINS)
def test_no_exchange_below_the_customer_joins(spark, small_tables, stored, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = run_entry(name, stored)
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
        at = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line or "ShuffledHashJoin" in line)
        assert "Exchange" not in "\n".join(lines[at:]) and sum("Bucketed: true" in line for line in lines[at:]) == 2
        got, want = df.collect(), run_entry(name, small_tables).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_flags_from_the_stored_table(small_tables, stored):
    a, b = run_entry("funnel_customers", stored), run_entry("funnel_customers", small_tables)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_figures_equal_separate_counts(spark, small_tables):
    t, quality = observed(small_tables)
    kept_tx, kept_ev = len(t.tx.collect()), t.ev.where("event_type is not null").count()
    tx, ev = small_tables.transactions, small_tables.events
    assert quality.of("transactions") == {
        "rows": tx.count(), "without_product": tx.where("product_id is null").count(),
        "signs_mended": tx.where("product_id is not null and (refund_flag is null or refund_flag <> 0) and gross_revenue < 0").count(),
        "without_refund_flag": tx.where("product_id is not null and refund_flag is null").count()}
    assert quality.of("events") == {
        "rows": ev.count(), "without_product": ev.where("event_type in ('purchase', 'add_to_cart') and product_id is null").count(),
        "unknown_type_without_product": ev.where("event_type is null and product_id is null").count(),
        "device_filled": ev.where("not (event_type in ('purchase', 'add_to_cart') and product_id is null) and device_type is null").count()}
    figures = quality.of("transactions")
    assert kept_tx == figures["rows"] - figures["without_product"] and figures["signs_mended"] > 0 and kept_ev > 0


def test_figures_come_with_the_query(spark):
    """One scan of the facts, and the query's own result."""
    from basketry.plans.tables import Tables
    plain = Tables.from_fixtures(spark, SF_SMALL)
    t, quality = observed(plain)
    df = run_entry("event_type_counts", t)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "CollectMetrics" in plan
    assert sorted(df.collect()) == sorted(run_entry("event_type_counts", plain).collect())
    assert quality.of("events")["rows"] == plain.events.count()


HEADER = "campaign_id,channel,objective,start_date,end_date,target_segment,expected_uplift\n"
GOOD = ["1,Paid Search,Cross-sell,2022-03-14,2022-04-02,Deal Seekers,0.031", "2,Email,Retention,2022-01-03,2022-02-14,,0.105",
        '3,"So, cial",Acquisition,2023-05-01,2023-06-30,New Customers,0.144']
BAD = ["x,Email,Retention,2022-01-03,2022-02-14,All,0.1", "4,Email,Retention,2022-13-03,2022-02-14,All,0.1", "5,Email", "6,Email,Retention,2022-01-03,2022-02-14,All,high",
       "7,Email,Retention,2022-01-03,2022-02-14,All,0.1,more"]


@pytest.mark.parametrize("good, bad", [(GOOD, BAD), (GOOD, []), ([], BAD), ([], [])])
def test_malformed_lines_are_set_apart(spark, tmp_path, good, bad):
    path = tmp_path / "campaigns.csv"
    lines = [x for pair in zip(good + [None] * 9, bad + [None] * 9) for x in pair if x]
    path.write_text(HEADER + "\n".join(lines) + ("\n" if lines else ""))
    got = ingest_csv(spark, "campaigns", str(path), str(tmp_path / "out"))
    assert (got.rows, got.malformed_rows) == (len(good), len(bad))
    assert sorted(r.campaign_id for r in got.good.collect()) == [1, 2, 3][:len(good)]
    assert sorted(r.malformed_line for r in got.malformed.collect()) == sorted(bad)
    from basketry.schemas import CAMPAIGNS
    assert got.good.schema == CAMPAIGNS


def test_a_missing_column_raises(spark, tmp_path):
    path = tmp_path / "campaigns.csv"
    path.write_text(HEADER.replace(",channel", "") + "1,a\n")
    with pytest.raises(ValueError, match="channel"):
        ingest_csv(spark, "campaigns", str(path), str(tmp_path / "out"))
