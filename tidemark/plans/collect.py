"""Collects queries by their functions' names, with their SQL."""

from __future__ import annotations

from collections.abc import Callable


def collector() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """(queries, SQL, decorator): the decorator takes a query's SQL, or nothing where SQL can't express it."""
    queries: dict[str, Callable] = {}
    texts: dict[str, str] = {}

    def query(sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql:
                texts[f.__name__] = sql
            return f

        return add

    return queries, texts, query
