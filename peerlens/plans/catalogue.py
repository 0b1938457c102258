"""All registered queries over the driver's tables, with their SQL."""

from __future__ import annotations

from . import company_queries, domain_queries, function_queries, graph_queries, lifecycle_queries, match_queries, page_queries, report_queries, source_queries, text_queries, vector_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
