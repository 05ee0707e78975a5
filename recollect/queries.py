"""The registered queries on the memory model and their SQL."""

from __future__ import annotations

from recollect.plans import merges, search, sessions, stores, streams
from recollect.plans.registry import QUERIES, SQL

__all__ = ["FLAGSHIP", "QUERIES", "SQL", "merges", "search", "sessions", "stores", "streams"]

FLAGSHIP = QUERIES["detect_duplicates"]
