"""The five raw tables plus their cleaned forms, built lazily once."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions import labels as L
from basketry.plans import clean
from basketry.sources import fixtures
from basketry.sources.tables import read_tables

# Recency anchor for the driver's fixture data (orders end in 2001).
FIXTURE_AS_OF = "2001-12-31"


Source = DataFrame | Callable[[], DataFrame]


class Tables:
    """Raw tables (``customers products campaigns events transactions``)
    and their cleaned views. Each raw table is a DataFrame or a zero-argument
    loader; loaders run on first use, so a query opens only the tables it
    reads. Nothing is computed until a query runs."""

    def __init__(self, customers: Source, products: Source, campaigns: Source,
                 events: Source, transactions: Source, as_of: str = L.RFM_AS_OF):
        self._sources = {"customers": customers, "products": products,
                         "campaigns": campaigns, "events": events,
                         "transactions": transactions}
        self.as_of = as_of
        self.shared: dict[str, DataFrame] = {}

    def _raw(self, name: str) -> DataFrame:
        src = self._sources[name]
        if not isinstance(src, DataFrame):
            src = self._sources[name] = src()
        return src

    customers = property(lambda self: self._raw("customers"))
    products = property(lambda self: self._raw("products"))
    campaigns = property(lambda self: self._raw("campaigns"))
    events = property(lambda self: self._raw("events"))
    transactions = property(lambda self: self._raw("transactions"))

    @classmethod
    def from_fixtures(cls, spark: SparkSession, sf_dir: str) -> Tables:
        return cls(**fixtures.load(spark, sf_dir), as_of=FIXTURE_AS_OF)

    @classmethod
    def read(cls, spark: SparkSession, paths: dict[str, str], fmt: str = "parquet",
             as_of: str = L.RFM_AS_OF) -> Tables:
        return cls(**read_tables(spark, paths, fmt), as_of=as_of)

    @cached_property
    def cu(self) -> DataFrame:
        return clean.clean_customers(self.customers)

    @cached_property
    def pr(self) -> DataFrame:
        return clean.clean_products(self.products)

    @cached_property
    def ca(self) -> DataFrame:
        return clean.clean_campaigns(self.campaigns)

    @cached_property
    def ev(self) -> DataFrame:
        return clean.clean_events(self.events)

    @cached_property
    def tx(self) -> DataFrame:
        return clean.clean_transactions(self.transactions)

    @property
    def sales(self) -> DataFrame:
        """Cleaned transactions that are not refunds (refund_flag = 0)."""
        return self.tx.filter(F.col("refund_flag") == L.SALE)

    def views(self) -> dict[str, DataFrame]:
        """Cleaned frames by view name, for ``register_views``."""
        return {"customers_clean": self.cu, "products_clean": self.pr,
                "campaigns_clean": self.ca, "events_clean": self.ev,
                "transactions_clean": self.tx}
