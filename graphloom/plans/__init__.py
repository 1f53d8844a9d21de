"""All registered queries, by module."""

from . import bundle_queries, graph_queries, late_queries, more_queries, propagation_queries, stream_queries, table_queries, tabular_queries, walk_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "bundle_queries", "graph_queries", "late_queries", "more_queries", "propagation_queries", "stream_queries", "table_queries", "tabular_queries", "walk_queries"]
