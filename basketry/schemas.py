"""Fixed schemas of the five raw commerce tables.

Tables are always read with these schemas (never ``inferSchema``: on CSV
that costs an extra pass over the data and mistypes keys). BIT flags are
integers so ``refund_flag = 0`` stays valid under ANSI mode.
"""

from pyspark.sql.types import (DateType, DecimalType, IntegerType, LongType,
                               StringType, StructField, StructType,
                               TimestampNTZType)

MONEY = DecimalType(18, 2)

CUSTOMERS = StructType([
    StructField("customer_id", LongType()),
    StructField("signup_date", DateType()),
    StructField("country", StringType()),
    StructField("age", IntegerType()),
    StructField("gender", StringType()),
    StructField("loyalty_tier", StringType()),
])

PRODUCTS = StructType([
    StructField("product_id", LongType()),
    StructField("category", StringType()),
    StructField("brand", StringType()),
    StructField("base_price", MONEY),
    StructField("launch_date", DateType()),
    StructField("is_premium", IntegerType()),
])

CAMPAIGNS = StructType([
    StructField("campaign_id", LongType()),
    StructField("channel", StringType()),
    StructField("objective", StringType()),
    StructField("start_date", DateType()),
    StructField("end_date", DateType()),
    StructField("target_segment", StringType()),
    StructField("expected_uplift", DecimalType(6, 3)),
])

EVENTS = StructType([
    StructField("event_id", LongType()),
    StructField("timestamp", TimestampNTZType()),
    StructField("customer_id", LongType()),
    StructField("session_id", LongType()),
    StructField("event_type", StringType()),
    StructField("product_id", LongType(), True),
    StructField("device_type", StringType(), True),
    StructField("traffic_source", StringType()),
    StructField("campaign_id", LongType(), True),
    StructField("page_category", StringType()),
])

TRANSACTIONS = StructType([
    StructField("transaction_id", LongType()),
    StructField("timestamp", TimestampNTZType()),
    StructField("customer_id", LongType()),
    StructField("product_id", LongType(), True),
    StructField("quantity", IntegerType()),
    StructField("discount_applied", DecimalType(6, 2)),
    StructField("gross_revenue", MONEY),
    StructField("campaign_id", LongType(), True),
    StructField("refund_flag", IntegerType()),
])

RAW_SCHEMAS = {
    "customers": CUSTOMERS,
    "products": PRODUCTS,
    "campaigns": CAMPAIGNS,
    "events": EVENTS,
    "transactions": TRANSACTIONS,
}
