"""All registered queries (import side effect fills the registry)."""

from . import catalogue_queries, file_queries, ingest_queries, output_queries, search_queries, table_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
