"""Named queries: each binds library operators to the driver tables."""

from __future__ import annotations

import importlib

_MODULES = (
    "source_queries",
    "text_queries",
    "entity_queries",
    "dedup_queries",
    "scoring_queries",
    "graph_queries",
    "time_queries",
    "robots_queries",
    "event_queries",
    "experiment_queries",
    "metric_queries",
    "render_queries",
    "stream_queries",
    "daily_queries",
)


def load_catalog():
    """(queries, checks), filled by importing the query modules."""
    for module in _MODULES:
        importlib.import_module(f"heliograph.plans.{module}")
    from heliograph.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
