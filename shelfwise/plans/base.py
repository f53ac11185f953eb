"""How modules of queries register them."""

from __future__ import annotations

from collections.abc import Callable


def collection() -> tuple[dict, dict[str, str], Callable]:
    """Queries by name, their SQL by name, and the decorator that fills both."""
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None):
        def put(f):
            queries[f.__name__] = f
            if sql is not None:
                oracles[f.__name__] = sql
            return f

        return put

    return queries, oracles, query
