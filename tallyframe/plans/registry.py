"""Named queries: each a function of (spark, table folder), most with an equivalent SQL text for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, and the SQL of those that have one."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        """Register a function under its own name, or `name`."""

        def keep(f: Query) -> Query:
            n = name or f.__name__
            if n in self.queries:
                raise ValueError(f"two queries are named {n}")
            self.queries[n] = f
            if sql is not None:
                self.sql[n] = sql
            return f

        return keep
