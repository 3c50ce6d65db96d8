"""Named queries over the given tables, each with its SQL check."""

from tidemark.catalog.base import CATALOG
from tidemark.catalog import account_queries, series_queries, store_queries, stream_queries  # noqa: F401  (register on import)

__all__ = ["CATALOG"]
