"""Queries of the graph engine by name, and their DuckDB equivalents."""

from __future__ import annotations

from .plans import change_queries, graph_queries, view_queries  # noqa: F401  (they register themselves)
from .plans.define import ORACLES, QUERIES

FLAGSHIP = "idle_customers"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
