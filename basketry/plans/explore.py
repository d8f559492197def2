"""C01-C05 entries and E01-E18: exploratory profiles.

"sales" = cleaned transactions with refund_flag = 0; ``rev`` =
``gross_revenue_clean``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions import labels as L
from basketry.functions.scalar import (age_group, as_double, mean, month_key, pct,
                                       product_type, purchase_band, ratio, round_half_up,
                                       weekday_name, weekday_number)
from basketry.operators.ranking import percentiles
from basketry.operators.shares import share_of_total
from basketry.plans.catalog import entry
from basketry.plans.lattice import distinct_of_sales, measures
from basketry.plans.tables import Tables

REV = "gross_revenue_clean"


# ---- cleaning entries -------------------------------------------------------

@entry("C01", "clean_customers")
def clean_customers(t: Tables) -> DataFrame:
    return t.cu


@entry("C02", "clean_products")
def clean_products(t: Tables) -> DataFrame:
    return t.pr.withColumn("base_price", as_double("base_price"))


@entry("C03", "clean_campaigns")
def clean_campaigns(t: Tables) -> DataFrame:
    return t.ca.withColumn("expected_uplift", as_double("expected_uplift"))


@entry("C04", "clean_events")
def clean_events(t: Tables) -> DataFrame:
    return t.ev


@entry("C05", "clean_transactions")
def clean_transactions(t: Tables) -> DataFrame:
    return (t.tx.withColumn("discount_applied", as_double("discount_applied"))
            .withColumn("gross_revenue_raw", as_double("gross_revenue_raw"))
            .withColumn(REV, as_double(REV)))


# ---- shared per-customer pre-aggregation -----------------------------------

def sales_per_customer(t: Tables) -> DataFrame:
    """One row per customer_id over sales: transaction count, revenue sum
    and count of non-null revenue (for exact averages after joins), first
    and last sale. A mart refresh computes it once and shares it
    (``t.shared``); otherwise it is planned inline."""
    if "customer_sales" in t.shared:
        return t.shared["customer_sales"]
    return t.sales.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("transaction_id").alias("n_tx"),
        F.sum(REV).alias("sum_rev"),
        F.count(REV).alias("n_rev"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"))


def per_product(t: Tables, sales_only: bool = False) -> DataFrame:
    """One row per product_id: the sums every product-level query needs,
    so the product join sees one row per product instead of the fact."""
    facts = measures(t, ["product_id", "refund_flag"])
    if sales_only:
        facts = facts.where(F.col("refund_flag") == L.SALE)
    is_sale = F.col("refund_flag") == L.SALE
    return facts.groupBy("product_id").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_tx").alias("n_tx"),
        F.sum(F.col("refund_flag") * F.col("n_rows")).alias("n_refund"),
        F.sum("sum_rev").alias("sum_rev"),
        F.sum("n_rev").alias("n_rev"),
        F.sum(F.when(is_sale, F.col("sum_rev")).otherwise(F.lit(0))).alias("sum_sale0"),
        F.sum(F.when(is_sale, F.col("n_rev")).otherwise(F.col("n_rows"))).alias("n_sale0"))


# ---- 1. distributions -------------------------------------------------------

@entry("E01", "revenue_distribution")
def revenue_distribution(t: Tables) -> DataFrame:
    """Count, min, max, mean, sample stddev and exact p25/p50/p75/p95 of sales
    revenue in one lazy plan: the first pass takes the statistics along with
    the sketch that brackets the percentiles, the last one gathers the rows
    inside the brackets (``percentiles``)."""
    found = percentiles(t.sales.select("transaction_id", REV), REV, {"p25": 0.25, "p50_median": 0.50, "p75": 0.75, "p95": 0.95},
                        "transaction_id", extra=[
                            F.count(F.lit(1)).alias("total_transactions"), F.min(REV).alias("min_revenue"),
                            F.max(REV).alias("max_revenue"), mean(REV).alias("avg_revenue"), F.stddev_samp(REV).alias("stddev_revenue")])
    return found.select("total_transactions", *[round_half_up(c).alias(c) for c in (
        "min_revenue", "max_revenue", "avg_revenue", "stddev_revenue", "p25", "p50_median", "p75", "p95")])


@entry("E02", "quantity_distribution")
def quantity_distribution(t: Tables) -> DataFrame:
    counts = t.sales.groupBy("quantity").agg(F.count(F.lit(1)).alias("total_transactions"))
    return share_of_total(counts, "total_transactions", "pct")


@entry("E03", "price_by_category")
def price_by_category(t: Tables) -> DataFrame:
    return t.pr.groupBy("category").agg(
        round_half_up(F.min("base_price")).alias("min_price"),
        round_half_up(F.max("base_price")).alias("max_price"),
        round_half_up(mean("base_price")).alias("avg_price"),
        round_half_up(F.stddev_samp("base_price")).alias("stddev_price"),
        F.count(F.lit(1)).alias("total_products"))


# ---- 2. temporal patterns ---------------------------------------------------

@entry("E04", "monthly_revenue")
def monthly_revenue(t: Tables) -> DataFrame:
    if "lattice" in t.shared:
        sales = F.col("refund_flag") == L.SALE
        sums = measures(t, ["month", "refund_flag"]).where(sales).groupBy("month").agg(
            F.sum("n_rows").alias("total_transactions"), round_half_up(F.sum("sum_rev")).alias("total_revenue"),
            round_half_up(ratio(F.sum("sum_rev"), F.sum("n_rev"))).alias("avg_order_value"))
        customers = distinct_of_sales(t, "month_customers", ["month"], "unique_customers", sales).withColumnRenamed("month", "_month")
        # a row for each month on both sides
        return (sums.join(customers, F.col("month").eqNullSafe(F.col("_month")), "left")
                .select("month", "total_transactions", F.coalesce("unique_customers", F.lit(0)).cast("long").alias("unique_customers"),
                        "total_revenue", "avg_order_value"))
    return t.sales.groupBy(month_key("timestamp").alias("month")).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.countDistinct("customer_id").alias("unique_customers"),
        round_half_up(F.sum(REV)).alias("total_revenue"),
        round_half_up(mean(REV)).alias("avg_order_value"))


@entry("E05", "weekday_revenue")
def weekday_revenue(t: Tables) -> DataFrame:
    return t.sales.groupBy(weekday_name("timestamp").alias("weekday_name"),
                           weekday_number("timestamp").alias("weekday_order")).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        round_half_up(F.sum(REV)).alias("total_revenue"),
        round_half_up(mean(REV)).alias("avg_order_value"))


@entry("E06", "hourly_events")
def hourly_events(t: Tables) -> DataFrame:
    return t.ev.groupBy(F.hour("timestamp").cast("bigint").alias("hour_of_day")).agg(
        F.count(F.lit(1)).alias("total_events"),
        F.countDistinct("session_id").alias("total_sessions"))


@entry("E07", "daily_revenue_stats")
def daily_revenue_stats(t: Tables) -> DataFrame:
    daily = t.sales.groupBy(F.to_date("timestamp").alias("date")).agg(
        F.sum(REV).alias("daily_revenue"))
    return daily.agg(
        round_half_up(F.min("daily_revenue")).alias("min_daily_revenue"),
        round_half_up(F.max("daily_revenue")).alias("max_daily_revenue"),
        round_half_up(mean("daily_revenue")).alias("avg_daily_revenue"),
        round_half_up(F.stddev_samp("daily_revenue")).alias("stddev_daily_revenue"))


# ---- 3. sessions and customers ----------------------------------------------

def _session_lengths(t: Tables) -> DataFrame:
    return t.ev.groupBy("session_id").agg(F.count(F.lit(1)).alias("events_per_session"))


@entry("E08", "session_length_stats")
def session_length_stats(t: Tables) -> DataFrame:
    return _session_lengths(t).agg(
        round_half_up(mean("events_per_session")).alias("avg_events"),
        F.min("events_per_session").alias("min_events"),
        F.max("events_per_session").alias("max_events"),
        round_half_up(F.stddev_samp(as_double("events_per_session"))).alias("stddev_events"))


@entry("E09", "events_per_session")
def events_per_session(t: Tables) -> DataFrame:
    hist = _session_lengths(t).groupBy("events_per_session").agg(
        F.count(F.lit(1)).alias("total_sessions"))
    return share_of_total(hist, "total_sessions", "pct")


@entry("E10", "purchase_recurrence")
def purchase_recurrence(t: Tables) -> DataFrame:
    per_customer = t.sales.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    bands = per_customer.groupBy(purchase_band("n").alias("purchase_segment")).agg(
        F.count(F.lit(1)).alias("total_customers"))
    return share_of_total(bands, "total_customers", "pct")


@entry("E11", "session_identity_check")
def session_identity_check(t: Tables) -> DataFrame:
    """Distinct sessions, customers and session/customer pairs. The pair key
    is the two ids written one after the other (NULL as empty), so (1, 11)
    and (11, 1) count as one pair — kept as specified."""
    session, customer = F.col("session_id"), F.col("customer_id")
    pairs = t.ev.select(session, customer).distinct()
    key = F.concat_ws("", session.cast("string"), customer.cast("string"))
    # three counts over the distinct pairs, each grouped by its own key
    sessions = pairs.where(session.isNotNull()).groupBy(session).agg(F.lit(1)).agg(F.count(F.lit(1)).alias("unique_sessions"))
    customers = pairs.where(customer.isNotNull()).groupBy(customer).agg(F.lit(1)).agg(F.count(F.lit(1)).alias("unique_customers"))
    combinations = pairs.groupBy(key.alias("_pair")).agg(F.lit(1)).agg(F.count(F.lit(1)).alias("unique_combinations"))
    names = ["unique_sessions", "unique_customers", "unique_combinations"]
    rows = sessions.unionByName(customers, allowMissingColumns=True).unionByName(combinations, allowMissingColumns=True)
    return rows.agg(*[F.max(n).alias(n) for n in names])


# ---- 4. correlations ----------------------------------------------------------

@entry("E12", "discount_bands")
def discount_bands(t: Tables) -> DataFrame:
    return t.sales.groupBy(F.round("discount_applied", 1).alias("_band")).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        round_half_up(mean(REV)).alias("avg_order_value"),
        round_half_up(F.sum(REV)).alias("total_revenue"),
    ).select(as_double("_band").alias("discount_band"), "total_transactions",
             "avg_order_value", "total_revenue")


def _customer_dim_join(t: Tables) -> DataFrame:
    """Sales pre-aggregated per customer, joined to the customer dimension
    (customer_id is its key): both sides hash on customer_id."""
    return sales_per_customer(t).join(t.cu, "customer_id", "inner")


@entry("E13", "loyalty_behavior")
def loyalty_behavior(t: Tables) -> DataFrame:
    return _customer_dim_join(t).groupBy("loyalty_tier").agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.sum("n_tx").alias("total_transactions"),
        round_half_up(ratio(F.sum("sum_rev"), F.sum("n_rev"))).alias("avg_order_value"),
        round_half_up(ratio(F.sum("n_tx"), F.count(F.lit(1)))).alias("transactions_per_customer"))


@entry("E14", "age_group_revenue")
def age_group_revenue(t: Tables) -> DataFrame:
    return _customer_dim_join(t).groupBy(age_group("age").alias("age_group")).agg(
        F.count(F.lit(1)).alias("total_customers"),
        round_half_up(ratio(F.sum("sum_rev"), F.sum("n_rev"))).alias("avg_order_value"),
        round_half_up(F.sum("sum_rev")).alias("total_revenue"))


@entry("E15", "premium_refund_profile")
def premium_refund_profile(t: Tables) -> DataFrame:
    """All transactions (refunds included) by premium flag."""
    joined = per_product(t).join(t.pr.select("product_id", "is_premium"), "product_id")
    return joined.groupBy("is_premium").agg(
        F.sum("n_rows").alias("total_transactions"),
        F.sum("n_refund").cast("bigint").alias("total_refunds"),
        pct(F.sum("n_refund"), F.sum("n_rows")).alias("refund_rate_pct"),
        round_half_up(ratio(F.sum("sum_rev"), F.sum("n_rev"))).alias("avg_order_value"),
    ).select(product_type("is_premium").alias("product_type"), "total_transactions",
             "total_refunds", "refund_rate_pct", "avg_order_value")


# ---- 5. acquisition ---------------------------------------------------------

@entry("E16", "monthly_signups")
def monthly_signups(t: Tables) -> DataFrame:
    return t.cu.groupBy(month_key("signup_date").alias("month")).agg(
        F.count(F.lit(1)).alias("new_customers"))


@entry("E17", "traffic_distribution")
def traffic_distribution(t: Tables) -> DataFrame:
    """Distinct customers per source; the percentage is of the sum of the
    per-source distinct counts (a customer seen on two sources counts
    twice in the denominator)."""
    per_source = t.ev.groupBy("traffic_source").agg(
        F.countDistinct("customer_id").alias("total_customers"))
    return share_of_total(per_source, "total_customers", "pct")


@entry("E18", "gender_within_tier")
def gender_within_tier(t: Tables) -> DataFrame:
    counts = t.cu.groupBy("loyalty_tier", "gender").agg(F.count(F.lit(1)).alias("total_customers"))
    return share_of_total(counts, "total_customers", "pct_within_tier", within=["loyalty_tier"])
