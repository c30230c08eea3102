"""Derived tables and the query catalog."""

from importlib import import_module

MODULES = ("candidate_queries", "interval_queries", "selection_queries", "topic_queries", "editing_queries",
           "evaluation_queries", "quality_queries", "function_queries",
           "stream_queries")


def load_catalog():
    """Import every query module once and return ``(queries, checks)``."""
    for module in MODULES:
        import_module(f"{__name__}.{module}")
    from .catalog import CHECKS, QUERIES

    return QUERIES, CHECKS
