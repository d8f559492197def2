"""R1-R4: metrics quoted in the narrative, derived from the same
building blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.scalar import count_if, month_key, pct, ratio, round_half_up
from basketry.plans.business import _bounce_flags, campaign_conversion
from basketry.plans.catalog import entry
from basketry.plans.explore import REV
from basketry.plans.tables import Tables


def _monthly(t: Tables) -> DataFrame:
    return t.sales.groupBy(month_key("timestamp").alias("month"),
                           F.year("timestamp").cast("bigint").alias("year"),
                           F.month("timestamp").cast("bigint").alias("month_of_year")).agg(
        F.sum(REV).alias("revenue"))


@entry("R1", "seasonality_index")
def seasonality_index(t: Tables) -> DataFrame:
    """Per calendar month: mean monthly sales revenue and its ratio to the
    mean over all months with sales."""
    per_moy = _monthly(t).groupBy("month_of_year").agg(
        F.count(F.lit(1)).alias("months"), F.sum("revenue").alias("_rev"))
    everything = Window.partitionBy()
    overall = ratio(F.sum("_rev").over(everything), F.sum("months").over(everything))
    return per_moy.select(
        "month_of_year", "months",
        round_half_up(ratio("_rev", "months")).alias("avg_monthly_revenue"),
        round_half_up(ratio("_rev", "months") / overall, 4).alias("seasonality_index"))


@entry("R2", "same_month_yoy")
def same_month_yoy(t: Tables) -> DataFrame:
    """Monthly sales revenue against the same calendar month of the
    previous year with sales."""
    w = Window.partitionBy("month_of_year").orderBy("year")
    m = _monthly(t).withColumn("_prev", F.lag("revenue").over(w))
    return m.select("month", round_half_up("revenue").alias("revenue"),
                    round_half_up("_prev").alias("prev_year_revenue"),
                    pct(F.col("revenue") - F.col("_prev"), "_prev").alias("yoy_growth_pct"))


@entry("R3", "campaign_target_attainment")
def campaign_target_attainment(t: Tables) -> DataFrame:
    """Campaigns whose conversion reached their expected uplift, compared
    exactly: converted >= uplift x exposed in decimals, nothing rounded."""
    cc = t.ca.join(campaign_conversion(t), "campaign_id")
    met = F.col("converted_customers").cast("decimal(20,0)") >= (
        F.col("expected_uplift").cast("decimal(6,3)") * F.col("exposed_customers").cast("decimal(20,0)"))
    return cc.agg(F.count(F.lit(1)).alias("campaigns_evaluated"),
                  count_if(met).alias("campaigns_met_target"),
                  pct(count_if(met), F.count(F.lit(1))).alias("attainment_pct"))


@entry("R4", "bounced_never_purchased")
def bounced_never_purchased(t: Tables) -> DataFrame:
    bounced = F.col("has_bounce") == 1
    never = bounced & (F.col("reached_purchase") == 0)
    return _bounce_flags(t).agg(count_if(bounced).alias("total_bounced"),
                                count_if(never).alias("bounced_never_purchased"),
                                pct(count_if(never), count_if(bounced)).alias("never_purchased_pct"))
