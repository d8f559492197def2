"""The corpus pipeline: quality classifier, exact dedup, MinHash near-dedup,
benchmark decontamination, packing.

``STAGES`` lists (name, function) pairs; a function takes (spark, docs,
sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basketry.llm.decontaminate import drop_contaminated
from basketry.llm.exact_dedup import drop_exact_copies
from basketry.llm.near_dedup import drop_near_copies
from basketry.llm.packing import pack_documents
from basketry.llm.quality import drop_low_quality
from basketry.llm.queries import VOCABULARY, table
from basketry.llm.workdir import saved, ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the classifier rejects go."""
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each group of equal texts stays."""
    ship_package(spark)
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6, on five-word shingles: one document of each group stays."""
    ship_package(spark)
    return drop_near_copies(docs, words=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that hold a passage of a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the pieces of every document, with their token ids, and
    their places in sequences of 2048."""
    ship_package(spark)
    return pack_documents(docs, VOCABULARY)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("packing", packing)]

# a trained classifier and a subword tokenizer: SQL cannot express the rows
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
