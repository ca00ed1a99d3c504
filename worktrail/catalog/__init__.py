"""Registered queries over the test tables."""

from __future__ import annotations

import importlib

MODULES = ["session_queries", "time_queries", "corpus_queries", "text_queries", "source_queries", "stream_queries"]


def load():
    """(queries, oracle SQL) of every query module."""
    for name in MODULES:
        importlib.import_module(f"worktrail.catalog.{name}")
    from worktrail.catalog.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
