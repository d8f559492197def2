"""Sources and sinks: typed CSV / Parquet readers, temp views, the mart
sink, and the stateless cleaning applied to a stream."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from basketry.plans import marts as V
from basketry.plans.clean import clean_events
from basketry.sources import read_table, register_views, write_marts
from basketry.schemas import CAMPAIGNS, EVENTS

CSV = """campaign_id,channel,objective,start_date,end_date,target_segment,expected_uplift
1,Paid Search,Cross-sell,2022-03-14,2022-04-02,Deal Seekers,0.031
2,Email,Retention,2022-01-03,2022-02-14,High Value,0.105
3,Social,Acquisition,2023-05-01,2023-06-30,New Customers,0.144
"""


def test_csv_reader_applies_fixed_schema(spark):
    d = tempfile.mkdtemp(prefix="basketry-csv-")
    path = os.path.join(d, "campaign_rows.csv")
    with open(path, "w") as f:
        f.write(CSV)
    df = read_table(spark, "campaigns", path, fmt="csv")
    assert df.schema == CAMPAIGNS
    rows = df.orderBy("campaign_id").collect()
    assert len(rows) == 3
    assert str(rows[0].start_date) == "2022-03-14" and str(rows[0].expected_uplift) == "0.031"
    assert rows[2].target_segment == "New Customers"


def test_csv_columns_are_found_by_name(spark):
    d = tempfile.mkdtemp(prefix="basketry-csv-")
    path = os.path.join(d, "reordered.csv")
    rows = [line.split(",") for line in CSV.strip().split("\n")]
    order = [2, 1, 0, 6, 5, 4, 3]
    with open(path, "w") as f:
        f.write("\n".join(",".join([r[i] for i in order] + ["more"]) for r in rows))
    got = read_table(spark, "campaigns", path, fmt="csv")
    assert got.schema == CAMPAIGNS
    first = got.orderBy("campaign_id").first()
    assert (first.channel, first.objective, str(first.expected_uplift)) == ("Paid Search", "Cross-sell", "0.031")
    with open(path, "w") as f:
        f.write("\n".join(",".join(r[:-1]) for r in rows))
    with pytest.raises(ValueError, match="expected_uplift"):
        read_table(spark, "campaigns", path, fmt="csv")


def test_parquet_reader_casts_to_schema(spark):
    d = tempfile.mkdtemp(prefix="basketry-pq-")
    spark.createDataFrame([(1, "Email", "Retention", "2021-01-01", "2021-02-01", "All", 0.1)],
                          "campaign_id int, channel string, objective string, start_date string,"
                          " end_date string, target_segment string, expected_uplift double") \
        .write.parquet(d + "/c")
    df = read_table(spark, "campaigns", d + "/c")
    assert df.schema == CAMPAIGNS


def test_views_and_mart_sink(spark, small_tables):
    names = register_views(small_tables.views())
    assert "transactions_clean" in names
    n = spark.sql("SELECT COUNT(*) AS n FROM transactions_clean WHERE refund_flag = 0").first().n
    assert n == small_tables.sales.count()
    out = tempfile.mkdtemp(prefix="basketry-marts-")
    marts = {"funnel_customers": V.funnel_customers(small_tables),
             "days_to_second_purchase": V.days_to_second_purchase(small_tables)}
    written = write_marts(marts, out)
    assert len(written) == 2
    back = spark.read.parquet(written[0])
    assert back.count() == marts["funnel_customers"].count()


def test_all_views_by_name(spark, small_tables):
    names = register_views(V.mart_views(small_tables))
    assert len(names) == 10
    assert spark.sql("select count(*) from rfm_segments").first()[0] == spark.table("rfm_segments").count() > 0


def test_cleaning_on_stream(spark, small_tables):
    src = tempfile.mkdtemp(prefix="basketry-stream-src-")
    small_tables.events.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(EVENTS).parquet(src)
    q = (clean_events(stream).writeStream.format("memory").queryName("events_clean_stream")
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = spark.table("events_clean_stream")
    assert got.count() == small_tables.ev.count()
    assert got.filter(F.col("device_type").isNull()).count() == 0


def test_build_marts_shares_customer_aggregate(spark):
    from conftest import SF_SMALL
    from basketry.plans.marts import MARTS, build_marts
    from basketry.plans.registry import run_entry
    from basketry.plans.tables import Tables
    shared_t = Tables.from_fixtures(spark, SF_SMALL)
    marts = build_marts(shared_t)
    assert list(marts) == MARTS and "customer_sales" in shared_t.shared
    plain_t = Tables.from_fixtures(spark, SF_SMALL)
    for name, df in marts.items():
        want = run_entry(name, plain_t)
        assert df.exceptAll(want).count() == 0 and want.exceptAll(df).count() == 0, name
    out = tempfile.mkdtemp(prefix="basketry-marts-all-")
    written = write_marts(marts, out)
    assert spark.read.parquet(written[3]).count() == plain_t.cu.count()
