"""Customer tables stored co-partitioned: bucketed and sorted by customer_id.

The customer joins (E13, E14, B09, B21, B29, V02, V04) meet one row a customer
on both sides. Stored with the same buckets, they need no exchange on either.
The facts are not bucketed by customer: a bucket is one task's work, and one
customer may hold a third of all rows. Their per-customer sums, which are what
the joins read, are stored instead; a hot customer is one row there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basketry.plans.explore import sales_per_customer
from basketry.plans.marts import funnel_flags
from basketry.plans.tables import Tables

PARTS = {"customers": lambda t: t.customers, "customer_sales": sales_per_customer, "customer_flags": funnel_flags}


def write_copartitioned(t: Tables, prefix: str, buckets: int, path: str | None = None) -> list[str]:
    """Save ``<prefix>_customers``, ``<prefix>_customer_sales`` and
    ``<prefix>_customer_flags`` as catalog tables with ``buckets`` buckets by
    customer_id (about 200 MB of the largest table each). Rows are shuffled by
    customer once, so that each bucket is one sorted file. ``path``: a folder
    for external tables instead of the warehouse."""
    names = []
    for part, make in PARTS.items():
        writer = (make(t).repartition(buckets, "customer_id").write.mode("overwrite").format("parquet")
                  .bucketBy(buckets, "customer_id").sortBy("customer_id"))
        if path:
            writer = writer.option("path", f"{path.rstrip('/')}/{part}")
        writer.saveAsTable(f"{prefix}_{part}")
        names.append(f"{prefix}_{part}")
    return names


def copartitioned(spark: SparkSession, prefix: str, t: Tables) -> Tables:
    """``t`` with its customers and per-customer aggregates from the stored
    tables; facts, products and campaigns stay as they are."""
    def stored(part: str) -> DataFrame:
        return spark.table(f"{prefix}_{part}")

    out = Tables(customers=stored("customers"), products=lambda: t.products, campaigns=lambda: t.campaigns,
                 events=lambda: t.events, transactions=lambda: t.transactions, as_of=t.as_of)
    out.shared |= {"customer_sales": stored("customer_sales"), "customer_flags": stored("customer_flags")}
    return out
