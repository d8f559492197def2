"""Table sources (CSV / Parquet with fixed schemas), temp views, mart sink,
and the fixture mapping from the driver's test tables."""

from basketry.sources.published import clear_versions, publication, publish, published_versions, read_published
from basketry.sources.tables import read_mart, read_table, read_tables, register_views, write_marts

__all__ = ["read_table", "read_tables", "register_views", "write_marts", "read_mart", "publish", "publication",
           "published_versions", "read_published", "clear_versions"]
