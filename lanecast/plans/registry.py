"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lanecast.plans.contest import BASE

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.QUERIES: dict[str, Query] = {}
        self.SQL: dict[str, str] = {}

    def query(self, sql: str | None = None, base: bool = True) -> Callable[[Query], Query]:
        """Registers a function under its name; sql: CTEs may follow BASE after a leading comma."""

        def add(f: Query) -> Query:
            self.QUERIES[f.__name__] = f
            if sql is not None:
                text = sql.strip()
                self.SQL[f.__name__] = (f"WITH {BASE}{text}" if text.startswith(",") else f"WITH {BASE}\n{text}") if base else text
            return f

        return add
