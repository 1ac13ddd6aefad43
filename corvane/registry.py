"""All registered queries and their SQL; importing the modules registers them."""

from __future__ import annotations

from corvane.plans import change_queries, detail_queries, history_queries, import_queries, link_queries, revision_queries, search_queries, text_queries  # noqa: F401
from corvane.plans.base import ORACLE_SQL, QUERIES

FLAGSHIP = "k4_where_search"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
