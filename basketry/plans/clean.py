"""C01-C05: cleaning transforms (non-destructive, DataFrame -> DataFrame)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions import labels as L


def clean_customers(customers: DataFrame) -> DataFrame:
    """C01: project the analytical columns; rows unchanged."""
    return customers.select("customer_id", "signup_date", "country", "age", "gender",
                            "loyalty_tier")


def clean_products(products: DataFrame) -> DataFrame:
    """C02: project the analytical columns; rows unchanged."""
    return products.select("product_id", "category", "brand", "base_price", "launch_date",
                           "is_premium")


def clean_campaigns(campaigns: DataFrame) -> DataFrame:
    """C03: project the analytical columns; rows unchanged."""
    return campaigns.select("campaign_id", "channel", "objective", "start_date", "end_date",
                            "target_segment", "expected_uplift")


def clean_events(events: DataFrame) -> DataFrame:
    """C04: drop purchase / add_to_cart events without a product; a missing
    device becomes 'Unknown'.

    SQL three-valued logic is kept: an event with NULL type and NULL
    product makes the predicate NULL and is dropped too.
    """
    needs_product = F.col("event_type").isin(*L.PRODUCT_EVENTS) & F.col("product_id").isNull()
    return events.filter(~needs_product).select(
        "event_id", "timestamp", "customer_id", "session_id", "event_type", "product_id",
        F.coalesce(F.col("device_type"), F.lit(L.UNKNOWN_DEVICE)).alias("device_type"),
        "traffic_source", "campaign_id", "page_category")


def clean_transactions(transactions: DataFrame) -> DataFrame:
    """C05: drop transactions without a product; keep the raw revenue and
    add ``gross_revenue_clean`` (positive for refunds); refund_flag as int.

    A NULL refund_flag takes the absolute-value branch and later matches
    neither ``= 0`` nor ``= 1``.
    """
    rev = F.col("gross_revenue")
    return transactions.filter(F.col("product_id").isNotNull()).select(
        "transaction_id", "timestamp", "customer_id", "product_id", "quantity",
        "discount_applied",
        rev.alias("gross_revenue_raw"),
        F.when(F.col("refund_flag") == L.SALE, rev).otherwise(F.abs(rev)).alias("gross_revenue_clean"),
        "campaign_id",
        F.col("refund_flag").cast("int").alias("refund_flag"))
