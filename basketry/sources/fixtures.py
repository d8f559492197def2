"""Fixture mapping: the driver's TPC-H-like tables -> the five raw commerce
tables.

The same expressions are written in SQL in ``basketry.oracle`` so both
engines see identical inputs. Every derived column is a deterministic
expression of the source row; nulls come only from the mapping rules.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the fixture mapping (label lists indexed by key modulo).
CHANNELS = ["Paid Search", "Email", "Display", "Social", "Affiliate"]
OBJECTIVES = ["Cross-sell", "Retention", "Reactivation", "Acquisition"]
TARGET_SEGMENTS = ["All", "Churn Risk", "High Value"]
GENDERS = ["F", "M", "Other"]
PAGE_CATEGORIES = ["home", "category", "product", "cart"]
SIGNUP_EPOCH = dt.date(1995, 1, 1)
LAUNCH_EPOCH = dt.date(1994, 1, 1)
CAMPAIGN_EPOCH = dt.date(1995, 1, 1)


def _pick(index: Column, labels: list[str]) -> Column:
    out = F.when(index == 0, F.lit(labels[0]))
    for i, label in enumerate(labels[1:-1], start=1):
        out = out.when(index == i, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


# Declared schemas of the driver tables (only the columns the mapping uses):
# reading with a known schema skips the footer-inference job per table.
DRIVER_SCHEMAS = {
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string",
    "part": "p_partkey bigint, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, "
                "l_discount double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, props string",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(DRIVER_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    n = _read(spark, sf_dir, "nation")
    key = F.col("c_custkey")
    return (c.join(n, c["c_nationkey"] == n["n_nationkey"], "inner")
            .select(key.alias("customer_id"),
                    F.date_add(F.lit(SIGNUP_EPOCH), (key * 37 % 2000).cast("int")).alias("signup_date"),
                    F.col("n_name").alias("country"),
                    (F.lit(18) + key * 13 % 60).cast("int").alias("age"),
                    _pick(key % 3, GENDERS).alias("gender"),
                    F.col("c_mktsegment").alias("loyalty_tier")))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return _read(spark, sf_dir, "part").select(
        key.alias("product_id"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").cast("decimal(18,2)").alias("base_price"),
        F.date_add(F.lit(LAUNCH_EPOCH), (key * 11 % 2500).cast("int")).alias("launch_date"),
        F.when(F.col("p_size") > 25, F.lit(1)).otherwise(F.lit(0)).alias("is_premium"))


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    start = F.date_add(F.lit(CAMPAIGN_EPOCH), (key * 53 % 2000).cast("int"))
    uplift_milli = F.lit(22) + key * 29 % 123
    return _read(spark, sf_dir, "supplier").select(
        key.alias("campaign_id"),
        _pick(key % 5, CHANNELS).alias("channel"),
        _pick(key % 4, OBJECTIVES).alias("objective"),
        start.alias("start_date"),
        F.date_add(start, (F.lit(10) + key * 7 % 80).cast("int")).alias("end_date"),
        _pick(key % 3, TARGET_SEGMENTS).alias("target_segment"),
        (uplift_milli.cast("decimal(10,0)") / F.lit(1000)).cast("decimal(6,3)").alias("expected_uplift"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    eid = F.col("event_id")
    etype = F.col("event_type")
    device_slot = eid % 13
    source_slot = eid % 11
    return _read(spark, sf_dir, "events").select(
        eid.alias("event_id"),
        F.col("ts").alias("timestamp"),
        (F.col("user_id") * 10 + eid % 10).alias("customer_id"),
        (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("session_id"),
        F.when(etype == "signup", F.lit("add_to_cart"))
         .when(etype == "error", F.lit("bounce"))
         .otherwise(etype).alias("event_type"),
        F.when(eid % 17 == 0, F.lit(None).cast("bigint"))
         .otherwise(F.regexp_extract("props", r"([0-9]+)", 1).try_cast("bigint")).alias("product_id"),
        F.when(device_slot < 5, F.lit("mobile"))
         .when(device_slot < 9, F.lit("desktop"))
         .when(device_slot < 11, F.lit("tablet")).alias("device_type"),
        F.when(source_slot < 2, F.lit("Organic"))
         .when(source_slot < 4, F.lit("Paid Search"))
         .when(source_slot < 6, F.lit("Email"))
         .when(source_slot < 8, F.lit("Direct"))
         .otherwise(F.lit("Social")).alias("traffic_source"),
        F.when(eid % 3 == 0, F.col("user_id")).alias("campaign_id"),
        _pick(eid % 4, PAGE_CATEGORIES).alias("page_category"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders LEFT JOIN (lineitem aggregated per order).

    The line-item side is reduced to one row per order before the join
    (partial aggregation map-side, one shuffle on the order key); orders
    without line items keep a NULL product_id.
    """
    o = _read(spark, sf_dir, "orders")
    lines = (_read(spark, sf_dir, "lineitem").groupBy("l_orderkey")
             .agg(F.min("l_partkey").alias("_part"),
                  F.min("l_quantity").alias("_qty"),
                  F.min("l_discount").alias("_disc"),
                  F.min("l_suppkey").alias("_supp")))
    refund = F.col("o_orderstatus") == "P"
    okey = F.col("o_orderkey")
    return (o.join(lines, okey == lines["l_orderkey"], "left")
            .select(okey.alias("transaction_id"),
                    F.col("o_orderdate").alias("timestamp"),
                    F.col("o_custkey").alias("customer_id"),
                    F.col("_part").alias("product_id"),
                    F.col("_qty").cast("int").alias("quantity"),
                    (F.col("_disc") * 3).cast("decimal(6,2)").alias("discount_applied"),
                    F.when(refund, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
                     .cast("decimal(18,2)").alias("gross_revenue"),
                    F.when(okey % 2 == 0, F.col("_supp")).alias("campaign_id"),
                    F.when(refund, F.lit(1)).otherwise(F.lit(0)).alias("refund_flag")))


def load(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], DataFrame]]:
    """Loaders of the five raw commerce tables derived from ``sf_dir``; a
    table is only opened when a query uses it."""
    return {name: partial(fn, spark, sf_dir) for name, fn in
            [("customers", customers), ("products", products), ("campaigns", campaigns),
             ("events", events), ("transactions", transactions)]}
