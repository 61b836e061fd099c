"""Registered queries and their oracle statements."""

from __future__ import annotations

from collections.abc import Callable

from .views import duck

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def check(name: str, oracle: str | None = None):
    """Registers a query (spark, folder) -> DataFrame, with a statement on views and tables."""
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = duck(oracle)
        return fn
    return register
