"""B01-B29: business queries (revenue, retention, campaigns, products,
segmentation, funnel, cohorts)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions import labels as L
from basketry.functions.scalar import (as_double, count_if, days_between, mean, month_key, pct,
                                       pct_raw, product_type, purchase_band, ratio, round_half_up,
                                       sum_if)
from basketry.operators.flags import conversion_by, distinct_with_flags, stage_flags
from basketry.operators.ranking import ntile_labels
from basketry.operators.sequence import nth_event_gap, with_previous
from basketry.operators.shares import share_of_total
from basketry.operators.topn import top_n_joined
from basketry.plans.catalog import entry
from basketry.plans.explore import REV, per_product, sales_per_customer
from basketry.plans.lattice import distinct_of_sales, measures
from basketry.plans.marts import rfm_scores
from basketry.plans.tables import Tables


# ---- 1. revenue & profitability ---------------------------------------------

@entry("B01", "north_star")
def north_star(t: Tables) -> DataFrame:
    """Net sales revenue, active customers and revenue per active customer."""
    if "lattice" in t.shared:
        sales = F.col("refund_flag") == L.SALE
        customers = distinct_of_sales(t, "month_customers", [], "_n", sales)
        one = (measures(t, ["refund_flag"]).where(sales).agg(F.sum("sum_rev").alias("_rev"))
               .withColumn("_n", customers.scalar()))
    else:
        one = t.sales.agg(F.sum(REV).alias("_rev"), F.countDistinct("customer_id").alias("_n"))
    return one.select(
        round_half_up("_rev").alias("net_revenue"),
        F.col("_n").alias("active_customers"),
        round_half_up(ratio("_rev", "_n")).alias("revenue_per_active_customer"))


@entry("B02", "gross_vs_refunds")
def gross_vs_refunds(t: Tables) -> DataFrame:
    """Total (sales + refunds, both positive), refunded amount and count, and
    refunded as a percentage of *sales* revenue."""
    is_refund = F.col("refund_flag") == L.REFUND
    is_sale = F.col("refund_flag") == L.SALE
    agg = measures(t, ["refund_flag"]).agg(
        F.sum("sum_rev").alias("_all"),
        F.sum(F.when(is_refund, F.col("sum_rev")).otherwise(F.lit(0))).alias("_refunded"),
        F.coalesce(F.sum(F.when(is_refund, F.col("n_rows"))), F.lit(0)).cast("long").alias("total_refund_transactions"),
        F.sum(F.when(is_sale, F.col("sum_rev")).otherwise(F.lit(0))).alias("_sales"))
    return agg.select(as_double("_all").alias("gross_revenue"),
                      as_double("_refunded").alias("total_refunded"),
                      "total_refund_transactions",
                      pct("_refunded", "_sales").alias("refund_revenue_pct"))


@entry("B03", "revenue_concentration")
def revenue_concentration(t: Tables) -> DataFrame:
    """NTILE(20) of sales by revenue (exact; ties by transaction_id): top
    tile vs the rest. Only the first row of the top tile is looked up, as a
    scalar subquery of the plan."""
    tiles = ntile_labels(t.sales.select("transaction_id", REV), L.REVENUE_TILES,
                         {"_top": (REV, False)}, "transaction_id", tiles=[L.REVENUE_TILES])
    segment = F.when(F.col("_top") == 2, F.lit(L.TOP_5_PCT)).otherwise(F.lit(L.BOTTOM_95_PCT))
    seg = tiles.groupBy(segment.alias("segment")).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.sum(REV).alias("_rev"))
    return share_of_total(seg, "_rev", "pct_of_revenue").select(
        "segment", "total_transactions", round_half_up("_rev").alias("total_revenue"),
        "pct_of_revenue")


@entry("B04", "mom_growth")
def mom_growth(t: Tables) -> DataFrame:
    """Monthly sales revenue, the previous month with sales, growth %."""
    monthly = t.sales.groupBy(month_key("timestamp").alias("month")).agg(
        F.sum(REV).alias("_rev"))
    lagged = with_previous(monthly, "month", "_rev", "_prev")
    return lagged.select(
        "month",
        round_half_up("_rev").alias("gross_revenue_clean"),
        round_half_up("_prev").alias("prev_month_revenue"),
        pct(F.col("_rev") - F.col("_prev"), "_prev").alias("mom_growth_pct"))


@entry("B05", "discount_impact")
def discount_impact(t: Tables) -> DataFrame:
    price_type = F.when(F.col("discounted"), F.lit(L.DISCOUNTED)).otherwise(F.lit(L.FULL_PRICE))
    sales = measures(t, ["refund_flag", "discounted"]).where(F.col("refund_flag") == L.SALE)
    agg = sales.groupBy(price_type.alias("price_type")).agg(
        F.sum("n_rows").alias("total_transactions"),
        round_half_up(ratio(F.sum("sum_rev"), F.sum("n_rev"))).alias("avg_order_value"),
        round_half_up(ratio(F.sum("sum_discount"), F.sum("n_discount"))).alias("avg_discount"),
        round_half_up(F.sum("sum_rev")).alias("total_revenue"))
    return share_of_total(agg, "total_transactions", "pct_of_transactions")


# ---- 2. retention & loyalty -------------------------------------------------

@entry("B06", "retention_rate")
def retention_rate(t: Tables) -> DataFrame:
    # purchasers with a known customer id (the count is per identified buyer)
    per_customer = (t.sales.filter(F.col("customer_id").isNotNull())
                    .groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")))
    return per_customer.agg(
        F.count(F.lit(1)).alias("total_customers"),
        sum_if(F.col("n") == 1).alias("one_time_buyers"),
        sum_if(F.col("n") > 1).alias("returning_buyers"),
        pct(sum_if(F.col("n") > 1), F.count(F.lit(1))).alias("retention_rate_pct"))


def second_purchase_gaps(t: Tables) -> DataFrame:
    """Per returning customer: days from the first to the second sale."""
    return nth_event_gap(t.sales, "customer_id", "timestamp", 1, 2, "days_to_second_purchase")


@entry("B07", "days_to_second_stats")
def days_to_second_stats(t: Tables) -> DataFrame:
    """Mean / min / max / median days to the second purchase, over the
    histogram of gaps (V05, one row per day count)."""
    d = F.col("days_to_second_purchase")
    gaps = second_purchase_gaps(t).groupBy(d).agg(F.count(F.lit(1)).alias("_n"))
    return gaps.agg(
        round_half_up(ratio(F.sum(d * F.col("_n")), F.sum(F.when(d.isNotNull(), F.col("_n")))), 1).alias("avg_days"),
        F.min(d).alias("min_days"),
        F.max(d).alias("max_days"),
        round_half_up(F.percentile(d.cast("double"), F.lit(0.5), F.col("_n")), 1).alias("median_days"))


@entry("B08", "revenue_by_frequency")
def revenue_by_frequency(t: Tables) -> DataFrame:
    per_customer = t.sales.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(REV).alias("total_revenue"))
    bands = per_customer.groupBy(purchase_band("n").alias("purchase_segment")).agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.sum("total_revenue").alias("_rev"),
        round_half_up(mean("total_revenue")).alias("avg_revenue_per_customer"))
    return share_of_total(bands, "_rev", "pct_of_total_revenue").select(
        "purchase_segment", "total_customers", round_half_up("_rev").alias("total_revenue"),
        "avg_revenue_per_customer", "pct_of_total_revenue")


@entry("B09", "loyalty_retention")
def loyalty_retention(t: Tables) -> DataFrame:
    per_customer = sales_per_customer(t).select("customer_id", F.col("n_rows").alias("n"))
    joined = t.cu.select("customer_id", "loyalty_tier").join(per_customer, "customer_id")
    return joined.groupBy("loyalty_tier").agg(
        F.count(F.lit(1)).alias("total_customers"),
        sum_if(F.col("n") > 1).alias("returning_customers"),
        pct(sum_if(F.col("n") > 1), F.count(F.lit(1))).alias("retention_rate_pct"),
        round_half_up(mean("n")).alias("avg_purchases"))


# ---- 3. campaigns & channels --------------------------------------------------

@entry("B10", "channel_performance")
def channel_performance(t: Tables) -> DataFrame:
    """All transactions (refunds included) attributed to a campaign, by
    channel. The narrow facts meet the campaigns first (broadcast, if Spark
    finds them small); one exchange, by (channel, transaction) with partial
    sums, then counts distinct transactions and sums at once."""
    if "lattice" in t.shared:
        return _from_lattice(t, "channel", None, {"campaign_transactions": "total_transactions"}, [
            round_half_up(F.sum(F.when(F.col("refund_flag") == L.SALE, F.col("sum_rev")).otherwise(F.lit(0)))).alias("net_revenue"),
            round_half_up(ratio(F.sum("sum_rev"), F.sum("n_rev"))).alias("avg_order_value"),
            pct(F.sum(F.col("refund_flag") * F.col("n_rows")), F.sum("n_rows")).alias("refund_rate_pct")]).select(
                "channel", "total_transactions", "net_revenue", "avg_order_value", "refund_rate_pct")
    return (_of_campaigns(t.tx, t, "channel")
            .groupBy("channel", "transaction_id").agg(*_campaign_sums())
            .groupBy("channel").agg(
                F.count("transaction_id").alias("total_transactions"),
                round_half_up(F.sum("_sales")).alias("net_revenue"),
                round_half_up(ratio(F.sum("_rev"), F.sum("_n_rev"))).alias("avg_order_value"),
                pct(F.sum("_refunds"), F.sum("_rows")).alias("refund_rate_pct")))


def _from_lattice(t: Tables, label: str, where: F.Column | None, distinct: dict[str, str], sums: list[F.Column]) -> DataFrame:
    """Per campaign ``label``: ``sums`` over the stored campaign summary, and
    the distinct counts of the kept ids, each under its name."""
    campaigns = t.ca.select("campaign_id", label)
    facts = measures(t, ["campaign_id", "refund_flag"])
    out = (facts.where(where) if where is not None else facts).join(campaigns, "campaign_id").groupBy(label).agg(*sums)
    for name, column in distinct.items():
        counts = distinct_of_sales(t, name, [label], column, where, campaigns, "campaign_id").withColumnRenamed(label, f"_{column}")
        # a row for each label on both sides
        out = (out.join(counts, F.col(label).eqNullSafe(F.col(f"_{column}")), "left").drop(f"_{column}")
               .withColumn(column, F.coalesce(column, F.lit(0)).cast("long")))
    return out


def _of_campaigns(tx: DataFrame, t: Tables, label: str) -> DataFrame:
    """Transactions with a campaign, narrow, with the campaign's ``label``."""
    facts = tx.select("campaign_id", "transaction_id", "customer_id", REV, "refund_flag").where(F.col("campaign_id").isNotNull())
    return facts.join(t.ca.select("campaign_id", label), "campaign_id")


def _campaign_sums() -> list[F.Column]:
    sale_or_zero = F.when(F.col("refund_flag") == L.SALE, F.col(REV)).otherwise(F.lit(0))
    return [F.sum(REV).alias("_rev"), F.count(REV).alias("_n_rev"), F.sum(sale_or_zero).alias("_sales"),
            F.sum(F.col("refund_flag").cast("int")).alias("_refunds"), F.count(F.lit(1)).alias("_rows")]


def campaign_conversion(t: Tables) -> DataFrame:
    """Per campaign: distinct exposed customers and distinct purchasers.
    Events without a campaign are dropped first (they cannot join)."""
    counts = distinct_with_flags(t.ev.filter(F.col("campaign_id").isNotNull()),
                                 ["campaign_id"], "customer_id",
                                 {"converted_customers": L.EVENT_PURCHASE})
    return counts.withColumnRenamed("total", "exposed_customers")


@entry("B11", "uplift_vs_conversion")
def uplift_vs_conversion(t: Tables) -> DataFrame:
    """Conversion % per campaign against expected uplift (a fraction, so
    scaled by 100 before subtracting)."""
    cc = campaign_conversion(t)
    conv = pct_raw("converted_customers", "exposed_customers")
    return t.ca.join(cc, "campaign_id").select(
        "campaign_id", "channel", "objective",
        as_double("expected_uplift").alias("expected_uplift"),
        round_half_up(conv).alias("actual_conversion_pct"),
        round_half_up(conv - as_double("expected_uplift") * 100).alias("uplift_gap"))


@entry("B12", "uplift_vs_conversion_points")
def uplift_vs_conversion_points(t: Tables) -> DataFrame:
    """Variant treating expected uplift as percentage points: the rounded
    conversion % minus the raw uplift value, plus the raw counts."""
    cc = campaign_conversion(t)
    conv = pct("converted_customers", "exposed_customers")
    return t.ca.join(cc, "campaign_id").select(
        "campaign_id", "channel", "objective",
        as_double("expected_uplift").alias("expected_uplift_pct"),
        conv.alias("actual_conversion_pct"),
        round_half_up(conv - as_double("expected_uplift")).alias("uplift_gap"),
        "exposed_customers", "converted_customers")


@entry("B13", "objective_performance")
def objective_performance(t: Tables) -> DataFrame:
    """Sales by campaign objective, from one scan and one exchange: each fact
    is a row for its transaction, with the sums, and a row for its customer;
    partial sums by (objective, kind, id) leave a row for each different one."""
    if "lattice" in t.shared:
        return _from_lattice(t, "objective", F.col("refund_flag") == L.SALE,
                             {"campaign_transactions": "total_transactions", "campaign_customers": "unique_customers"},
                             [round_half_up(F.sum("sum_rev")).alias("gross_revenue_clean"),
                              round_half_up(ratio(F.sum("sum_rev"), F.sum("n_rev"))).alias("avg_order_value")]).select(
                                 "objective", "total_transactions", "gross_revenue_clean", "avg_order_value", "unique_customers")
    kinds = F.array(F.struct(F.lit(True).alias("is_tx"), F.col("transaction_id").alias("id"), F.col(REV).alias("rev")),
                    F.struct(F.lit(False).alias("is_tx"), F.col("customer_id").alias("id"), F.lit(None).cast("decimal(18,2)").alias("rev")))
    ids = (_of_campaigns(t.sales, t, "objective").select("objective", F.inline(kinds))
           .groupBy("objective", "is_tx", "id").agg(F.sum("rev").alias("_rev"), F.count("rev").alias("_n_rev")))
    return ids.groupBy("objective").agg(
        F.count(F.when(F.col("is_tx"), F.col("id"))).alias("total_transactions"),
        round_half_up(F.sum("_rev")).alias("gross_revenue_clean"),
        round_half_up(ratio(F.sum("_rev"), F.sum("_n_rev"))).alias("avg_order_value"),
        F.count(F.when(~F.col("is_tx"), F.col("id"))).alias("unique_customers"))


@entry("B14", "exposure_effect")
def exposure_effect(t: Tables) -> DataFrame:
    """Purchasers split by whether any of their events carried a campaign.
    Both sides are reduced to one row per customer and hash on customer_id,
    so the left join needs no further shuffle."""
    exposed = (t.ev.filter(F.col("campaign_id").isNotNull())
               .select(F.col("customer_id").alias("_exposed_id")).distinct())
    revenue = t.sales.groupBy("customer_id").agg(
        F.sum(REV).alias("total_revenue"), F.count(F.lit(1)).alias("total_purchases"))
    joined = revenue.join(exposed, revenue["customer_id"] == exposed["_exposed_id"], "left")
    label = F.when(F.col("_exposed_id").isNotNull(), F.lit(L.EXPOSED)).otherwise(F.lit(L.NOT_EXPOSED))
    return joined.groupBy(label.alias("campaign_exposure")).agg(
        F.count(F.lit(1)).alias("total_customers"),
        round_half_up(mean("total_revenue")).alias("avg_revenue_per_customer"),
        round_half_up(mean("total_purchases")).alias("avg_purchases_per_customer"))


# ---- 4. products ----------------------------------------------------------

def _product_rollup(t: Tables, dims: list[str], sales_only: bool = False) -> DataFrame:
    """Fact pre-aggregated per product, joined to the product dimension."""
    return per_product(t, sales_only).join(t.pr.select("product_id", *dims), "product_id")


def _product_measures():
    """Row count, net sales revenue, and AOV with refunds counted as 0."""
    return [
        F.sum("n_rows").alias("total_transactions"),
        round_half_up(F.sum("sum_sale0")).alias("net_revenue"),
        round_half_up(ratio(F.sum("sum_sale0"), F.sum("n_sale0"))).alias("avg_order_value"),
    ]


@entry("B15", "category_performance")
def category_performance(t: Tables) -> DataFrame:
    """All transactions by category; AOV counts refunds as 0."""
    rolled = _product_rollup(t, ["category"])
    return rolled.groupBy("category").agg(
        F.sum("n_tx").alias("total_transactions"),
        *_product_measures()[1:],
        pct(F.sum("n_refund"), F.sum("n_rows")).alias("refund_rate_pct"))


@entry("B16", "top_products")
def top_products(t: Tables) -> DataFrame:
    """Top 10 products by sales revenue (ties by product_id)."""
    per = per_product(t, sales_only=True).select(
        "product_id",
        F.col("n_tx").alias("total_transactions"),
        round_half_up("sum_sale0").alias("net_revenue"),
        round_half_up(ratio("sum_sale0", "n_sale0")).alias("avg_order_value"))
    dim = t.pr.select("product_id", "category", "brand", "is_premium")
    return top_n_joined(
        per, dim, "product_id",
        [F.col("net_revenue").desc_nulls_last(), F.col("product_id").asc()], L.TOP_N,
        ["product_id", "category", "brand", product_type("is_premium").alias("product_type"),
         "total_transactions", "net_revenue", "avg_order_value"])


@entry("B17", "premium_performance")
def premium_performance(t: Tables) -> DataFrame:
    """All transactions by premium flag; AOV counts refunds as 0."""
    rolled = _product_rollup(t, ["is_premium"])
    return rolled.groupBy("is_premium").agg(
        *_product_measures(),
        pct(F.sum("n_refund"), F.sum("n_rows")).alias("refund_rate_pct"),
    ).select(product_type("is_premium").alias("product_type"), "total_transactions",
             "net_revenue", "avg_order_value", "refund_rate_pct")


@entry("B18", "category_by_premium")
def category_by_premium(t: Tables) -> DataFrame:
    rolled = _product_rollup(t, ["category", "is_premium"], sales_only=True)
    return rolled.groupBy("category", "is_premium").agg(*_product_measures()).select(
        "category", product_type("is_premium").alias("product_type"), "total_transactions",
        "net_revenue", "avg_order_value")


# ---- 5. segmentation ----------------------------------------------------------

def _by_segment(scored: DataFrame) -> DataFrame:
    """A row for each RFM segment that has customers, with its sums, and the
    sum over all (``_total``): the labels are known, so one global aggregate
    does, and its one row is unpivoted."""
    sums = {"_n": "count(1)", "_rev": "sum(monetary)", "_n_rev": "count(monetary)", "_days": "sum(recency_days)",
            "_n_days": "count(recency_days)", "_purchases": "sum(frequency)"}
    segments = [", ".join([f"'rfm_segment', '{label}'", *(f"'{k}', {x} FILTER (WHERE rfm_segment = '{label}')" for k, x in sums.items())])
                for label, _ in L.RFM_SEGMENTS]
    one = scored.agg(F.expr("array(" + ", ".join(f"named_struct({s})" for s in segments) + ")").alias("_segments"),
                     F.sum("monetary").alias("_total"))
    return one.select("_total", F.inline("_segments")).where("_n > 0")


@entry("B19", "rfm_summary")
def rfm_summary(t: Tables) -> DataFrame:
    return _by_segment(rfm_scores(t, invert=False)).select(
        "rfm_segment", F.col("_n").alias("total_customers"), round_half_up("_rev").alias("total_revenue"),
        round_half_up(ratio("_rev", "_n_rev")).alias("avg_revenue_per_customer"),
        round_half_up(ratio("_days", "_n_days"), 0).alias("avg_recency_days"),
        round_half_up(ratio("_purchases", "_n")).alias("avg_frequency"),
        pct("_rev", "_total").alias("pct_of_revenue"))


@entry("B20", "rfm_summary_inverted")
def rfm_summary_inverted(t: Tables) -> DataFrame:
    """Same scoring with every tile order reversed (best customers score 1)
    while the labels stay: kept as specified, B19 is the meaningful one."""
    return _by_segment(rfm_scores(t, invert=True)).select(
        "rfm_segment", F.col("_n").alias("total_customers"), round_half_up("_rev").alias("total_revenue"),
        round_half_up(ratio("_rev", "_n_rev")).alias("avg_revenue_per_customer"),
        pct("_rev", "_total").alias("pct_of_revenue"))


@entry("B21", "top_customers")
def top_customers(t: Tables) -> DataFrame:
    """Top 10 customers by sales revenue (ties by customer_id) with profile."""
    per = sales_per_customer(t).select(
        "customer_id",
        F.col("n_rows").alias("total_purchases"),
        round_half_up("sum_rev").alias("total_revenue"),
        days_between("first_ts", "last_ts").alias("customer_lifespan_days"))
    dim = t.cu.select("customer_id", "country", "age", "loyalty_tier")
    return top_n_joined(
        per, dim, "customer_id",
        [F.col("total_revenue").desc_nulls_last(), F.col("customer_id").asc()], L.TOP_N,
        ["customer_id", "country", "age", "loyalty_tier", "total_purchases", "total_revenue",
         "customer_lifespan_days"])


# ---- 6. funnel & conversion ---------------------------------------------------

FUNNEL_STAGES = {"view_stage": L.EVENT_VIEW, "click_stage": L.EVENT_CLICK,
                 "cart_stage": L.EVENT_CART, "purchase_stage": L.EVENT_PURCHASE}


def funnel_counts(t: Tables) -> DataFrame:
    """One row: distinct customers reaching each stage (independent counts,
    not an ordered funnel)."""
    per_customer = stage_flags(t.ev.filter(F.col("customer_id").isNotNull()), ["customer_id"],
                               FUNNEL_STAGES)
    return per_customer.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in FUNNEL_STAGES])


@entry("B22", "funnel")
def funnel(t: Tables) -> DataFrame:
    return funnel_counts(t).select(
        *FUNNEL_STAGES,
        pct("click_stage", "view_stage").alias("view_to_click_pct"),
        pct("cart_stage", "click_stage").alias("click_to_cart_pct"),
        pct("purchase_stage", "cart_stage").alias("cart_to_purchase_pct"),
        pct("purchase_stage", "view_stage").alias("overall_conversion_pct"))


@entry("B23", "device_conversion")
def device_conversion(t: Tables) -> DataFrame:
    return conversion_by(t.ev, "device_type")


@entry("B24", "traffic_conversion")
def traffic_conversion(t: Tables) -> DataFrame:
    return conversion_by(t.ev, "traffic_source")


@entry("B25", "funnel_dropoff")
def funnel_dropoff(t: Tables) -> DataFrame:
    """Three step rows from the one funnel row (computed once, then
    unpivoted with ``stack``)."""
    pieces = ", ".join(f"'{label}', {a}, {b}" for label, a, b in L.FUNNEL_STEPS)
    steps = funnel_counts(t).select(
        F.expr(f"stack({len(L.FUNNEL_STEPS)}, {pieces})")
        .alias("funnel_step", "customers_in", "customers_out"))
    return steps.select(
        "funnel_step", "customers_in", "customers_out",
        (F.col("customers_in") - F.col("customers_out")).alias("dropped"),
        pct(F.col("customers_in") - F.col("customers_out"), "customers_in").alias("drop_off_pct"))


def _bounce_flags(t: Tables) -> DataFrame:
    return stage_flags(t.ev.filter(F.col("customer_id").isNotNull()), ["customer_id"],
                       {"has_bounce": L.EVENT_BOUNCE, "reached_purchase": L.EVENT_PURCHASE})


@entry("B26", "bounce_rate")
def bounce_rate(t: Tables) -> DataFrame:
    return _bounce_flags(t).agg(
        count_if(F.col("has_bounce") == 1).alias("bounced_customers"),
        F.count(F.lit(1)).alias("total_customers"),
        pct(count_if(F.col("has_bounce") == 1), F.count(F.lit(1))).alias("bounce_rate_pct"))


@entry("B27", "bounce_recovery")
def bounce_recovery(t: Tables) -> DataFrame:
    """Bounced customers who purchased at any time (no event order)."""
    bounced = F.col("has_bounce") == 1
    both = bounced & (F.col("reached_purchase") == 1)
    return _bounce_flags(t).agg(
        count_if(bounced).alias("total_bounced"),
        count_if(both).alias("bounced_and_purchased"),
        pct(count_if(both), count_if(bounced)).alias("bounce_recovery_rate_pct"))


@entry("B28", "event_type_counts")
def event_type_counts(t: Tables) -> DataFrame:
    return t.ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("total_events"))


@entry("B29", "cohort_ltv")
def cohort_ltv(t: Tables) -> DataFrame:
    joined = sales_per_customer(t).join(t.cu.select("customer_id", "signup_date"), "customer_id")
    return joined.groupBy(month_key("signup_date").alias("signup_cohort")).agg(
        F.count(F.lit(1)).alias("customers"),
        round_half_up(ratio(F.sum("sum_rev"), F.count(F.lit(1)))).alias("avg_ltv"),
        round_half_up(ratio(F.sum("sum_rev"), F.sum("n_rev"))).alias("avg_order_value"),
        round_half_up(ratio(F.sum("n_tx"), F.count(F.lit(1)))).alias("avg_purchases_per_customer"))


__all__ = ["second_purchase_gaps", "funnel_counts", "campaign_conversion"]
