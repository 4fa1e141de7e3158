"""Queries and the SQL beside them, kept by name as they are defined."""

from __future__ import annotations

from collections.abc import Callable


def registry(prepare: Callable[[str], str] = str) -> tuple[dict, dict[str, str], Callable]:
    """Queries, their SQL, and the decorator that keeps both; `prepare` completes SQL texts."""
    queries: dict = {}
    texts: dict[str, str] = {}

    def query(sql: str | None = None):
        def keep(f):
            queries[f.__name__] = f
            if sql:
                texts[f.__name__] = prepare(sql)
            return f

        return keep

    return queries, texts, query
