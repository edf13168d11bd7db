"""Names, callables and DuckDB SQL of every query of the engine."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, oracle: str | None = None):
    """Decorator: add ``fn(spark, sf_dir)`` under ``name``, with its SQL where SQL can express it."""

    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def load() -> None:
    """Import all modules that register queries."""
    from .plans import queries_graph, queries_items, queries_sources, queries_streams, queries_weak  # noqa: F401
