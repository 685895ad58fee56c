"""A table of registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries of one module under a prefix; ``query`` registers a function under its own name."""

    def __init__(self, prefix: str):
        self.prefix, self.found, self.sql = prefix, {}, {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.found[f"{self.prefix}_{f.__name__}"] = f
            if sql:
                self.sql[f"{self.prefix}_{f.__name__}"] = sql
            return f

        return add

    def queries(self) -> dict[str, Query]:
        return dict(self.found)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self.sql)
