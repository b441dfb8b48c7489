"""All queries over the test tables, and the SQL that checks them."""

from . import editorial_queries, event_queries, function_queries, ingest_queries, store_queries  # noqa: F401  each module registers its queries
from .tables import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
