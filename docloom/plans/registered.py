"""All named queries of the library and their SQL."""

from __future__ import annotations

from . import field_queries, flow_queries, index_queries, record_queries  # noqa: F401  (they add to the catalogue)
from .catalogue import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
