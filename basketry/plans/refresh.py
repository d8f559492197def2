"""Incremental refresh of the marts from mergeable per-customer states.

A ``MartStore`` keeps, in one published set (``sources.published``):

* the log: the raw transactions of every batch;
* ``sales_state``: per customer the counts, sums, first and last sale and the
  two earliest timestamps;
* ``event_state``: per customer the funnel stages reached, as bits;
* the customers, and the marts V01-V05 computed from the states.

``apply`` merges a batch. New sales and events are aggregated and merged into
the states: only the batch and the states are read. A transaction whose id came
before (a late refund, a mended amount) replaces its earlier version: earliest
and latest sale cannot be taken back from a state, so the states of the
customers that lose a sale are computed again from their log rows. A batch that
was applied before changes nothing. Everything a batch changes is published at
once.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.functions import labels as L
from basketry.plans.explore import REV
from basketry.plans.marts import FUNNEL_FLAGS, MARTS, build_marts
from basketry.plans.tables import Tables
from basketry.schemas import RAW_SCHEMAS
from basketry.sources.published import publication, publish, published_versions, read_published, write_unpublished

BATCH = "_batch"
SUM_TYPE = "decimal(38,2)"


def sales_state(sales: DataFrame) -> DataFrame:
    """Per customer_id over cleaned sales: ``sales_per_customer``'s columns
    and ``firsts``, the two earliest sales (NULL timestamps first)."""
    order = Window.partitionBy("customer_id").orderBy(F.col("timestamp").asc_nulls_first())
    # WindowGroupLimit: two rows a customer and task are shuffled
    firsts = (sales.where(F.col("customer_id").isNotNull()).select("customer_id", "timestamp", F.row_number().over(order).alias("_nth"))
              .where(F.col("_nth") <= 2).groupBy("customer_id")
              .agg(F.sort_array(F.collect_list(F.struct(F.col("timestamp").alias("ts")))).alias("firsts")))
    sums = sales.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("transaction_id").alias("n_tx"),
        F.sum(REV).cast(SUM_TYPE).alias("sum_rev"), F.count(REV).alias("n_rev"),
        F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))
    return sums.join(firsts, "customer_id", "left")


def merged_sales_states(states: DataFrame) -> DataFrame:
    """One state per customer_id from a union of states of disjoint sales."""
    firsts = F.flatten(F.collect_list("firsts"))
    merged = states.groupBy("customer_id").agg(
        *[F.sum(c).alias(c) for c in ("n_rows", "n_tx")], F.sum("sum_rev").cast(SUM_TYPE).alias("sum_rev"), F.sum("n_rev").alias("n_rev"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        F.slice(F.sort_array(firsts), 1, 2).alias("firsts"))
    return merged.withColumn("firsts", F.when(F.size("firsts") > 0, F.col("firsts")))


def event_state(events: DataFrame) -> DataFrame:
    """Per customer_id the funnel stages of cleaned events as a bit set."""
    bits: Column = F.lit(0)
    for k, stage in enumerate(FUNNEL_FLAGS.values()):
        bits = bits.bitwiseOR(F.when(F.col("event_type") == stage, F.lit(1 << k)).otherwise(F.lit(0)))
    return events.groupBy("customer_id").agg(F.bit_or(bits).alias("stages"))


def merged_event_states(states: DataFrame) -> DataFrame:
    return states.groupBy("customer_id").agg(F.bit_or("stages").alias("stages"))


def stage_columns(state: DataFrame) -> DataFrame:
    """The mart's 0/1 columns from the bit set."""
    return state.select("customer_id", *[F.col("stages").bitwiseAND(F.lit(1 << k)).cast("boolean").cast("int").alias(name)
                                         for k, name in enumerate(FUNNEL_FLAGS)])


def second_gaps(state: DataFrame) -> DataFrame:
    """Per customer with two sales: days from the first to the second."""
    from basketry.functions.scalar import days_between
    first, second = F.col("firsts")[0]["ts"], F.col("firsts")[1]["ts"]
    return (state.where((F.size("firsts") == 2) & second.isNotNull())
            .select("customer_id", days_between(first, second).alias("days_to_second_purchase")))


def _latest(rows: DataFrame) -> DataFrame:
    """Rows of each transaction_id from the last batch that has it; rows
    without an id all stay."""
    known = rows.where(F.col("transaction_id").isNotNull())
    last = known.groupBy("transaction_id").agg(F.max(BATCH).alias(BATCH))
    return known.join(last, ["transaction_id", BATCH], "left_semi").select(*rows.columns).unionByName(rows.where(F.col("transaction_id").isNull()))


def _same(a: DataFrame, b: DataFrame, column: str) -> Column:
    return a[column].eqNullSafe(b[column])


class MartStore:
    """The published states and marts at ``path``."""

    def __init__(self, spark: SparkSession, path: str, as_of: str = L.RFM_AS_OF):
        self.spark, self.path, self.as_of = spark, path, as_of

    def _publication(self) -> dict:
        if not published_versions(self.spark, self.path):
            return {"version": 0, "tables": {}, "notes": {"batches": [], "log": []}}
        return publication(self.spark, self.path)

    def batches(self) -> list[str]:
        """Names of the batches that were applied, in order."""
        return self._publication()["notes"]["batches"]

    def _empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], RAW_SCHEMAS[name])

    def _log(self, now: dict) -> DataFrame:
        """All transactions of all batches, with the batch's number."""
        folders = [now["tables"][name] for name in now["notes"]["log"]]
        if not folders:
            return self._empty("transactions").withColumn(BATCH, F.lit(0))
        return self.spark.read.parquet(*folders)

    def transactions(self) -> DataFrame:
        """The raw transactions as all batches together leave them."""
        return _latest(self._log(self._publication())).drop(BATCH)

    def _tables(self, customers: DataFrame, transactions: DataFrame | None = None, events: DataFrame | None = None) -> Tables:
        return Tables(customers=customers, products=lambda: self._empty("products"), campaigns=lambda: self._empty("campaigns"),
                      events=events if events is not None else self._empty("events"),
                      transactions=transactions if transactions is not None else self._empty("transactions"), as_of=self.as_of)

    def _sales(self, transactions: DataFrame) -> DataFrame:
        return self._tables(self._empty("customers"), transactions).sales

    def apply(self, batch: str, transactions: DataFrame | None = None, events: DataFrame | None = None,
              customers: DataFrame | None = None) -> int:
        """Merge a batch of raw rows (``customers``: the whole table, if it
        changed) and publish; returns the version. A batch applied before is
        left out."""
        now = self._publication()
        notes, tables = now["notes"], now["tables"]
        if batch in notes["batches"]:
            return now["version"]
        number = len(notes["batches"])
        kept, log_names = dict(tables), list(notes["log"])
        people = customers if customers is not None else self._stored(tables, "customers", self._empty("customers"))
        states: dict[str, DataFrame] = {}
        if events is not None:
            delta = event_state(self._tables(people, events=events).ev)
            states["event_state"] = merged_event_states(self._with_stored(tables, "event_state", delta))
        if transactions is not None:
            columns = RAW_SCHEMAS["transactions"].names
            states[f"log_{number}"] = transactions.select(*columns).withColumn(BATCH, F.lit(number))
            log_names.append(f"log_{number}")
            states["sales_state"] = self._merged_sales(now, transactions.select(*columns), number)
        if customers is not None:
            states["customers"] = customers
        for name in ("event_state", "sales_state", "customers"):
            if name not in states and name not in kept:
                states[name] = {"event_state": event_state(self._tables(people).ev), "sales_state": sales_state(self._sales(self._empty("transactions"))),
                                "customers": people}[name]
        # states first, then the marts read what was written; one pointer shows both
        notes = {"batches": [*notes["batches"], batch], "log": log_names}
        kept = {**{n: f for n, f in kept.items() if n not in MARTS}, **write_unpublished(states, self.path)}
        frames = build_marts(self._from_states(kept), share=False)
        return publish(self.spark, frames, self.path, notes, kept=kept, after=now["version"])

    def _stored(self, tables: Mapping[str, str], name: str, default: DataFrame) -> DataFrame:
        return self.spark.read.parquet(tables[name]) if name in tables else default

    def _with_stored(self, tables: Mapping[str, str], name: str, delta: DataFrame) -> DataFrame:
        return self.spark.read.parquet(tables[name]).unionByName(delta) if name in tables else delta

    def _merged_sales(self, now: dict, delta: DataFrame, number: int) -> DataFrame:
        new = sales_state(self._sales(delta))
        if "sales_state" not in now["tables"]:
            return merged_sales_states(new)
        stored, log = self.spark.read.parquet(now["tables"]["sales_state"]), self._log(now)
        ids = delta.where(F.col("transaction_id").isNotNull()).select("transaction_id").distinct()
        before = _latest(log.join(ids, "transaction_id", "left_semi").select(*log.columns))
        losing = self._sales(before.where(F.col("transaction_id").isNotNull()).drop(BATCH)).select("customer_id").distinct()
        if losing.isEmpty():
            return merged_sales_states(stored.unionByName(new))
        # customers that lose a sale: from their rows, as they are with this batch
        rows = log.unionByName(delta.withColumn(BATCH, F.lit(number)))
        theirs = rows.join(losing, _same(rows, losing, "customer_id"), "left_semi")
        touched = theirs.select("transaction_id").where(F.col("transaction_id").isNotNull()).distinct()
        candidates = rows.join(touched, "transaction_id", "left_semi").select(*rows.columns).unionByName(theirs.where(F.col("transaction_id").isNull()))
        current = _latest(candidates).drop(BATCH)
        again = sales_state(self._sales(current.join(losing, _same(current, losing, "customer_id"), "left_semi")))
        others = stored.unionByName(new)
        others = others.join(losing, _same(others, losing, "customer_id"), "left_anti")
        return merged_sales_states(others.unionByName(again))

    def _from_states(self, tables: Mapping[str, str]) -> Tables:
        t = self._tables(self.spark.read.parquet(tables["customers"]))
        state = self.spark.read.parquet(tables["sales_state"])
        t.shared["customer_sales"] = state
        t.shared["customer_gaps"] = second_gaps(state)
        t.shared["customer_flags"] = stage_columns(self.spark.read.parquet(tables["event_state"]))
        return t

    def mart(self, name: str, version: int | None = None) -> DataFrame:
        return read_published(self.spark, self.path, name, version)
