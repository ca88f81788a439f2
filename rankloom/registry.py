"""All named queries of the core and the SQL they are compared with."""

from __future__ import annotations

from .queries import QUERIES, SQL

FLAGSHIP = "per_query_metrics"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
