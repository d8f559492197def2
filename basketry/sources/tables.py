"""Sources and sinks: typed table readers (S1, S2), temp views (S3) and the
mart sink (S4)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from basketry.schemas import RAW_SCHEMAS
from basketry.sources.published import publication, publish, read_published


def csv_header(spark: SparkSession, name: str, path: str) -> list[str]:
    """Column names in the header of a raw table's CSV file; raises if one of
    the table's columns is missing."""
    header = spark.read.option("header", True).csv(path).columns
    if missing := [f.name for f in RAW_SCHEMAS[name].fields if f.name not in header]:
        raise ValueError(f"{path}: no column {', '.join(missing)} in the header")
    return header


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """Read one raw table with its fixed schema.

    ``fmt="csv"``: header row, comma separated, ISO dates
    (``yyyy-MM-dd``) and timestamps. Columns are found by their header names,
    in any order, and typed while parsing (no inference pass); a missing
    column raises, further ones are ignored, and a file whose header differs
    from the first one's fails. ``fmt="parquet"``: columns are selected and
    cast to the fixed schema, which keeps column pruning and filter
    pushdown intact.
    """
    schema = RAW_SCHEMAS[name]
    if fmt == "csv":
        header = csv_header(spark, name, path)
        in_file = StructType([schema[c] if c in schema.names else StructField(c, StringType()) for c in header])
        return (spark.read.schema(in_file)
                .option("header", True)
                .option("enforceSchema", False)
                .option("sep", ",")
                .option("dateFormat", "yyyy-MM-dd")
                .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
                .option("mode", "FAILFAST")
                .csv(path)
                .select(*schema.names))
    if fmt == "parquet":
        df = spark.read.parquet(path)
        return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    raise ValueError(f"unsupported format {fmt!r}")


def read_tables(spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet") -> dict[str, DataFrame]:
    """Read the five raw tables (``customers products campaigns events
    transactions``) from ``paths``."""
    return {name: read_table(spark, name, paths[name], fmt) for name in RAW_SCHEMAS}


def register_views(frames: Mapping[str, DataFrame]) -> list[str]:
    """Expose frames as temp views so SQL users can query them by name
    (the DataFrame analogue of CREATE / ALTER VIEW)."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return sorted(frames)


def write_marts(marts: Mapping[str, DataFrame], path: str,
                partition_by: Mapping[str, list[str]] | None = None) -> list[str]:
    """Publish mart frames as Parquet tables for BI tools, all at once
    (``published``): until the last of them is written, and if one fails,
    ``read_mart`` gives the marts that were there before. Returns the tables'
    folders. Every task writes its own files; nothing passes through the
    driver."""
    spark = next(iter(marts.values())).sparkSession
    version = publish(spark, marts, path, partition_by=partition_by)
    tables = publication(spark, path, version)["tables"]
    return [tables[name] for name in marts]


def read_mart(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    """A mart of the latest publication at ``path``, or of ``version``."""
    return read_published(spark, path, name, version)
