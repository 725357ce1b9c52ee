"""Named queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """queries: name -> function of (spark, folder); sql: name -> the same result in SQL, where SQL can express it."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
        def keep(f: Callable) -> Callable:
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return keep
