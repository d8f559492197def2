"""V01-V05: customer-level marts for BI tools, and the RFM scoring shared
with the segmentation summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions import labels as L
from basketry.functions.scalar import (age_group, as_double, days_between, flag, month_key,
                                       ratio, round_half_up)
from basketry.operators.flags import stage_flags
from basketry.operators.ranking import ntile_labels
from basketry.operators.sequence import nth_event_gap
from basketry.plans.catalog import entry
from basketry.plans.explore import sales_per_customer
from basketry.plans.tables import Tables


def rfm_base(t: Tables) -> DataFrame:
    """Per purchasing customer: days since the last sale (to ``t.as_of``),
    number of sales, and sales revenue rounded to cents before scoring
    (derived from the shared per-customer sales aggregate)."""
    return sales_per_customer(t).select(
        "customer_id",
        days_between("last_ts", F.to_date(F.lit(t.as_of))).alias("recency_days"),
        F.col("n_rows").alias("frequency"),
        F.round("sum_rev", 2).alias("monetary"))


def _segment(total) -> F.Column:
    out = None
    for label, threshold in L.RFM_SEGMENTS[:-1]:
        cond = total >= threshold
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(L.RFM_SEGMENTS[-1][0]))


def rfm_scores(t: Tables, invert: bool = False) -> DataFrame:
    """Per customer: NTILE(4) scores for recency (most recent = 4),
    frequency and monetary (highest = 4), their sum and segment label.

    Every tile order ends with customer_id ascending so ties are
    deterministic. ``invert=True`` reverses all three orders (best
    customers score 1) but keeps the labels. The at most three cut points
    (value, customer_id) of each score are exact scalar subqueries
    (``ntile_labels``) that read the same exchange of per-customer sums;
    customers are labelled in place, so none is shuffled or sorted for the
    ranking.
    """
    scored = ntile_labels(rfm_base(t), L.RFM_TILES,
                          {"r_score": ("recency_days", not invert), "f_score": ("frequency", invert),
                           "m_score": ("monetary", invert)}, "customer_id")
    total = F.col("r_score") + F.col("f_score") + F.col("m_score")
    return scored.select("customer_id", "recency_days", "frequency", "monetary",
                         "r_score", "f_score", "m_score", total.alias("rfm_total"),
                         _segment(total).alias("rfm_segment"))


@entry("V01", "rfm_segments")
def rfm_segments(t: Tables) -> DataFrame:
    return rfm_scores(t).withColumn("monetary", as_double("monetary"))


@entry("V02", "cohort_analysis")
def cohort_analysis(t: Tables) -> DataFrame:
    """Every customer (buyers or not) with signup cohort and sales metrics.
    Purchases count 0 for non-buyers; revenue and AOV stay NULL."""
    p = sales_per_customer(t)
    return t.cu.join(p, "customer_id", "left").select(
        "customer_id",
        month_key("signup_date").alias("signup_cohort"),
        F.coalesce(F.col("n_tx"), F.lit(0)).cast("bigint").alias("total_purchases"),
        round_half_up("sum_rev").alias("total_revenue"),
        round_half_up(ratio("sum_rev", "n_rev")).alias("avg_order_value"),
        F.col("first_ts").alias("first_purchase_date"),
        F.col("last_ts").alias("last_purchase_date"))


FUNNEL_FLAGS = {"reached_view": L.EVENT_VIEW, "reached_click": L.EVENT_CLICK,
                "reached_cart": L.EVENT_CART, "reached_purchase": L.EVENT_PURCHASE,
                "has_bounce": L.EVENT_BOUNCE}


def funnel_flags(t: Tables) -> DataFrame:
    if "customer_flags" in t.shared:
        return t.shared["customer_flags"]
    return stage_flags(t.ev, ["customer_id"], FUNNEL_FLAGS)


@entry("V03", "funnel_customers")
def funnel_customers(t: Tables) -> DataFrame:
    return funnel_flags(t)


@entry("V04", "customer_summary")
def customer_summary(t: Tables) -> DataFrame:
    """Every customer with age band, sales metrics (0 when none) and
    returning / never-purchased flags."""
    p = sales_per_customer(t)
    n = F.col("n_rows")
    return t.cu.join(p, "customer_id", "left").select(
        "customer_id", "signup_date", "country", "age", "gender", "loyalty_tier",
        age_group("age").alias("age_group"),
        F.coalesce(n, F.lit(0)).cast("bigint").alias("total_purchases"),
        F.coalesce(round_half_up("sum_rev"), F.lit(0.0)).alias("total_revenue"),
        F.coalesce(round_half_up(ratio("sum_rev", "n_rev")), F.lit(0.0)).alias("avg_order_value"),
        F.col("first_ts").alias("first_purchase_date"),
        F.col("last_ts").alias("last_purchase_date"),
        F.coalesce(days_between("first_ts", "last_ts"), F.lit(0)).cast("bigint").alias("lifespan_days"),
        flag(n > 1).alias("is_returning"),
        flag(n.isNull()).alias("never_purchased"))


@entry("V05", "days_to_second_purchase")
def days_to_second_purchase(t: Tables) -> DataFrame:
    gaps = t.shared.get("customer_gaps")
    if gaps is None:
        gaps = nth_event_gap(t.sales, "customer_id", "timestamp", 1, 2, "days_to_second_purchase")
    return gaps.groupBy("days_to_second_purchase").agg(F.count(F.lit(1)).alias("total_customers"))


def mart_views(t: Tables) -> dict[str, DataFrame]:
    """The five cleaned frames and the five marts by view name, for
    ``register_views``. All lazy: nothing runs here, and a query of a view
    computes it from the tables as they are then."""
    return t.views() | build_marts(t, share=False)


MARTS = ["rfm_segments", "cohort_analysis", "funnel_customers", "customer_summary",
         "days_to_second_purchase"]


def build_marts(t: Tables, share: bool = True) -> dict[str, DataFrame]:
    """V01-V05 for a BI refresh. With ``share`` the per-customer sales
    aggregate (read by V01, V02 and V04) is computed once and checkpointed
    instead of once per mart; write the result with
    ``basketry.sources.write_marts``."""
    if share and "customer_sales" not in t.shared:
        from basketry.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(t.sales.sparkSession)
        t.shared["customer_sales"] = sales_per_customer(t).checkpoint(eager=True)
    fns = {"rfm_segments": rfm_segments, "cohort_analysis": cohort_analysis,
           "funnel_customers": funnel_customers, "customer_summary": customer_summary,
           "days_to_second_purchase": days_to_second_purchase}
    return {name: fns[name](t) for name in MARTS}
