"""All entries in id order, and helpers to run them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.plans import business, explore, marts, narrative  # noqa: F401  (register entries)
from basketry.plans.catalog import CATALOG, Entry
from basketry.plans.tables import Tables

_GROUP_ORDER = {"C": 0, "E": 1, "B": 2, "V": 3, "R": 4}

ENTRIES: dict[str, Entry] = dict(
    sorted(CATALOG.items(), key=lambda kv: (_GROUP_ORDER[kv[1].key[0]], int(kv[1].key[1:]))))

# Row order of the small results, by entry: a leading "-" sorts descending
# (NULLs last), otherwise ascending (NULLs first); the last column breaks ties.
ROW_ORDER = {
    "quantity_distribution": ["quantity"],
    "price_by_category": ["-avg_price", "category"],
    "monthly_revenue": ["month"],
    "weekday_revenue": ["weekday_order"],
    "hourly_events": ["hour_of_day"],
    "events_per_session": ["events_per_session"],
    "purchase_recurrence": ["-total_customers", "purchase_segment"],
    "discount_bands": ["discount_band"],
    "loyalty_behavior": ["-avg_order_value", "loyalty_tier"],
    "age_group_revenue": ["age_group"],
    "monthly_signups": ["month"],
    "traffic_distribution": ["-total_customers", "traffic_source"],
    "gender_within_tier": ["loyalty_tier", "-total_customers", "gender"],
    "mom_growth": ["month"],
    "revenue_by_frequency": ["-total_customers", "purchase_segment"],
    "loyalty_retention": ["-retention_rate_pct", "loyalty_tier"],
    "channel_performance": ["-net_revenue", "channel"],
    "uplift_vs_conversion": ["-uplift_gap", "campaign_id"],
    "uplift_vs_conversion_points": ["-actual_conversion_pct", "campaign_id"],
    "objective_performance": ["-gross_revenue_clean", "objective"],
    "category_performance": ["-net_revenue", "category"],
    "top_products": ["-net_revenue", "product_id"],
    "premium_performance": ["-net_revenue", "product_type"],
    "category_by_premium": ["category", "product_type"],
    "rfm_summary": ["-total_revenue", "rfm_segment"],
    "rfm_summary_inverted": ["-total_revenue", "rfm_segment"],
    "top_customers": ["-total_revenue", "customer_id"],
    "device_conversion": ["-conversion_rate_pct", "device_type"],
    "traffic_conversion": ["-conversion_rate_pct", "traffic_source"],
    "event_type_counts": ["-total_events", "event_type"],
    "cohort_ltv": ["signup_cohort"],
}
_TOP_N = {"top_products", "top_customers"}      # ordered by their limit already


def run_entry(name: str, tables: Tables) -> DataFrame:
    df = ENTRIES[name].fn(tables)
    if name not in ROW_ORDER or name in _TOP_N:
        return df
    return df.orderBy(*[F.col(c[1:]).desc_nulls_last() if c[0] == "-" else F.col(c).asc_nulls_first()
                        for c in ROW_ORDER[name]])


def fixture_query(name: str):
    """Callable (spark, sf_dir) -> DataFrame over the driver's test tables."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_entry(name, Tables.from_fixtures(spark, sf_dir))
    run.__name__ = name
    return run
