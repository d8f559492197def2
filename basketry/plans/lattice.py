"""A lattice of stored summaries of the transactions, and a chooser.

``write_lattice`` groups the facts once by all of ``KEYS`` with measures that
add up, derives smaller tables from that one, and keeps bitmaps of ids for the
distinct counts, which don't add up. ``with_lattice`` gives tables whose
queries read the smallest stored table that holds their keys instead of the
facts: B02, B05, B10, B13, B15-B18, E15 and the sales columns and distinct
counts of B01 and E04.

Queries are written once: a fact is a group of one, so ``measures`` has the
same columns with and without a lattice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.scalar import month_key
from basketry.operators.bitmaps import dense_ids, distinct_bitmaps, distinct_counts, merged_bitmaps
from basketry.plans.tables import Tables
from basketry.sources.published import publication, publish, write_unpublished

KEYS = ["month", "campaign_id", "product_id", "refund_flag", "discounted"]
MEASURES = ["n_rows", "n_tx", "sum_rev", "n_rev", "sum_discount", "n_discount"]
# of each table: its keys; the first holds all
SUMMARIES = {"facts": KEYS, "products": ["product_id", "refund_flag"], "campaigns": ["campaign_id", "refund_flag"],
             "months": ["month", "refund_flag"], "discounts": ["refund_flag", "discounted"]}
# groups whose distinct ids are kept
DISTINCT = {"campaign_transactions": (["campaign_id", "refund_flag"], "transaction_id"),
            "campaign_customers": (["campaign_id", "refund_flag"], "customer_id"),
            "month_customers": (["month", "refund_flag"], "customer_id")}
REV = "gross_revenue_clean"


def _keyed(t: Tables) -> DataFrame:
    return t.tx.select(month_key("timestamp").alias("month"), "campaign_id", "product_id", "refund_flag",
                       F.coalesce(F.col("discount_applied") > 0, F.lit(False)).alias("discounted"),
                       "transaction_id", "customer_id", REV, "discount_applied")


def _one(c: str) -> Column:
    return F.col(c).isNotNull().cast("long")


def _rows(t: Tables, keys: Sequence[str]) -> DataFrame:
    """Each fact as a group of one."""
    return _keyed(t).select(*keys, F.lit(1).cast("long").alias("n_rows"), _one("transaction_id").alias("n_tx"),
                            F.col(REV).alias("sum_rev"), _one(REV).alias("n_rev"),
                            F.col("discount_applied").alias("sum_discount"), _one("discount_applied").alias("n_discount"))


def _summed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    decimals = {"sum_rev": "decimal(38,2)", "sum_discount": "decimal(38,2)"}
    return df.groupBy(*keys).agg(*[F.sum(m).cast(decimals.get(m, "long")).alias(m) for m in MEASURES])


def measures(t: Tables, keys: Sequence[str]) -> DataFrame:
    """``keys`` and MEASURES, over groups that are at least as fine: the
    smallest stored summary with these keys, or the facts themselves. Sums
    over it are sums over all cleaned transactions."""
    lattice = t.shared.get("lattice")
    return lattice.smallest(keys).select(*keys, *MEASURES) if lattice else _rows(t, keys)


class Lattice:
    """Stored summaries at ``path``, as of one publication."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path = spark, path
        self._now = publication(spark, path, version)
        self.version = self._now["version"]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._now["tables"][name])

    def smallest(self, keys: Sequence[str]) -> DataFrame:
        rows = self._now["notes"]["rows"]
        fit = [name for name, have in SUMMARIES.items() if set(keys) <= set(have)]
        return self.table(min(fit, key=lambda name: rows[name]))

    def bitmaps(self, name: str) -> DataFrame:
        """``dims``, BUCKET and BITMAP of the ids kept under ``name``."""
        return self.table(name)


def _parts(t: Tables, numbers: dict[str, DataFrame]) -> dict[str, DataFrame]:
    facts = _keyed(t)
    return {name: distinct_bitmaps(facts, dims, entity, numbers[entity]) for name, (dims, entity) in DISTINCT.items()}


def _published(spark: SparkSession, path: str, base: DataFrame, bitmaps: dict[str, DataFrame], kept: dict[str, str], batches: list[str], after: int) -> int:
    # the large one first: the others and the row counts read what was written, not the facts
    folders = write_unpublished({"facts": base}, path)
    stored = spark.read.parquet(folders["facts"])
    folders |= write_unpublished({n: _summed(stored, keys) for n, keys in SUMMARIES.items() if n != "facts"}, path)
    rows = {name: spark.read.parquet(folders[name]).count() for name in SUMMARIES}
    return publish(spark, bitmaps, path, {"rows": rows, "batches": batches}, kept={**kept, **folders}, after=after)


def write_lattice(spark: SparkSession, t: Tables, path: str, batch: str = "all") -> int:
    """Compute and publish the lattice of ``t``; returns the version."""
    entities = {entity for _, entity in DISTINCT.values()}
    folders = write_unpublished({f"{e}_numbers": dense_ids(t.tx, e) for e in entities}, path)
    numbers = {e: spark.read.parquet(folders[f"{e}_numbers"]) for e in entities}
    return _published(spark, path, _summed(_rows(t, KEYS), KEYS), _parts(t, numbers), folders, [batch], 0)


def merge_into_lattice(spark: SparkSession, path: str, delta: Tables, batch: str) -> int:
    """Merge new transactions: measures add up, bitmaps are ORed, new ids get
    further numbers. For batches of new rows; a batch of a name that was merged
    before is left out."""
    old = Lattice(spark, path)
    notes = old._now["notes"]
    if batch in notes["batches"]:
        return old.version
    entities = {entity for _, entity in DISTINCT.values()}
    folders = write_unpublished({f"{e}_numbers": dense_ids(delta.tx, e, known=old.table(f"{e}_numbers")) for e in entities}, path)
    numbers = {e: spark.read.parquet(folders[f"{e}_numbers"]) for e in entities}
    base = _summed(old.table("facts").unionByName(_summed(_rows(delta, KEYS), KEYS)), KEYS)
    bitmaps = {name: merged_bitmaps(old.table(name).unionByName(new), DISTINCT[name][0]) for name, new in _parts(delta, numbers).items()}
    return _published(spark, path, base, bitmaps, folders, [*notes["batches"], batch], old.version)


def with_lattice(spark: SparkSession, t: Tables, path: str, version: int | None = None) -> Tables:
    """``t``, answering from the stored lattice where it can."""
    out = Tables(customers=lambda: t.customers, products=lambda: t.products, campaigns=lambda: t.campaigns,
                 events=lambda: t.events, transactions=lambda: t.transactions, as_of=t.as_of)
    out.shared |= {**t.shared, "lattice": Lattice(spark, path, version)}
    return out


def distinct_of_sales(t: Tables, name: str, dims: Sequence[str], out: str, where: Column | None = None,
                      labels: DataFrame | None = None, on: str = "") -> DataFrame:
    """``dims`` and the distinct count of the ids kept as ``name``, over the
    groups that pass ``where``, after a join with ``labels`` on ``on``."""
    found = t.shared["lattice"].bitmaps(name)
    if where is not None:
        found = found.where(where)
    if labels is not None:
        found = found.join(labels, on)
    return distinct_counts(found, dims, out)

