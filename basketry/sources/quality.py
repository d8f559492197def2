"""Data-quality figures from the pass that the data takes anyway.

* ``observed``: tables whose cleaning counts what each rule drops or mends.
  The counters (``Observation``) ride on the first action over the cleaned
  frame; there is no second scan.
* ``ingest_csv``: reads raw CSV lines, keeps the good rows typed, and sets
  malformed lines apart, in one job that writes both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from basketry.functions import labels as L
from basketry.functions.scalar import count_if
from basketry.plans.tables import Tables
from basketry.schemas import RAW_SCHEMAS
from basketry.sources.tables import csv_header

CORRUPT = "malformed_line"


def _event_figures() -> dict[str, Column]:
    kept = ~(F.col("event_type").isin(*L.PRODUCT_EVENTS) & F.col("product_id").isNull())
    return {"rows": F.count(F.lit(1)),
            "without_product": count_if(~F.coalesce(kept, F.lit(True))),
            "unknown_type_without_product": count_if(kept.isNull()),
            "device_filled": count_if(kept & F.col("device_type").isNull())}


def _transaction_figures() -> dict[str, Column]:
    kept = F.col("product_id").isNotNull()
    sale = F.coalesce(F.col("refund_flag") == L.SALE, F.lit(False))
    return {"rows": F.count(F.lit(1)),
            "without_product": count_if(~kept),
            "signs_mended": count_if(kept & ~sale & (F.col("gross_revenue") < 0)),
            "without_refund_flag": count_if(kept & F.col("refund_flag").isNull())}


FIGURES = {"events": _event_figures, "transactions": _transaction_figures}


@dataclass(frozen=True)
class Quality:
    """Figures by table; ``of`` waits for the first action over the table's
    cleaned frame to end."""

    observations: dict[str, Observation]

    def of(self, table: str) -> dict[str, int]:
        return dict(self.observations[table].get)


def observed(t: Tables) -> tuple[Tables, Quality]:
    """``t`` with counters on its events and transactions. Use a fresh one for
    each run: a counter belongs to the first action over its table. Filters
    aren't pushed below a counter, which has to see the rows."""
    seen = {name: Observation(f"quality-{name}") for name in FIGURES}
    frames = {name: getattr(t, name).observe(o, *[c.alias(k) for k, c in FIGURES[name]().items()]) for name, o in seen.items()}
    out = Tables(customers=lambda: t.customers, products=lambda: t.products, campaigns=lambda: t.campaigns,
                 events=frames["events"], transactions=frames["transactions"], as_of=t.as_of)
    return out, Quality(seen)


@dataclass(frozen=True)
class Ingested:
    """``good``: typed rows; ``malformed``: the lines (one column) that don't
    fit the schema; ``rows`` and ``malformed_rows``: how many."""

    good: DataFrame
    malformed: DataFrame
    rows: int
    malformed_rows: int


def ingest_csv(spark: SparkSession, name: str, path: str, target: str) -> Ingested:
    """Read the raw CSV table ``name`` once and write it to the folder
    ``target`` as Parquet, partitioned into typed rows and malformed lines
    (a value that can't be parsed, too few or too many columns). Columns are
    found by header name; a missing one raises. ``read_table`` is the strict
    way, where the first malformed line ends the job."""
    schema, header = RAW_SCHEMAS[name], csv_header(spark, name, path)
    in_file = StructType([schema[c] if c in schema.names else StructField(c, StringType()) for c in header]
                         + [StructField(CORRUPT, StringType())])
    lines = (spark.read.schema(in_file).option("header", True).option("enforceSchema", False).option("sep", ",")
             .option("dateFormat", "yyyy-MM-dd").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
             .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    seen = Observation(f"ingest-{name}")
    bad = F.col(CORRUPT).isNotNull()
    lines = lines.select(*schema.names, CORRUPT).withColumn("is_malformed", bad).observe(
        seen, count_if(~bad).alias("rows"), count_if(bad).alias("malformed_rows"))
    lines.write.partitionBy("is_malformed").parquet(target)
    stored_schema = StructType([*schema.fields, StructField(CORRUPT, StringType())])

    def part(flag: str) -> DataFrame:
        have = f"{target.rstrip('/')}/is_malformed={flag}"
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(have)
        if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            return spark.createDataFrame([], stored_schema)
        return spark.read.schema(stored_schema).parquet(have)

    found = seen.get
    return Ingested(part("false").select(*schema.names), part("true").select(CORRUPT), found["rows"], found["malformed_rows"])
