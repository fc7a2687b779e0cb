"""Named queries beside the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .binding import Tables, sql_views


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        """Register f(tables) under `name`; `sql` may name views of binding.py in braces."""

        def keep(f):
            self.queries[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                self.oracles[name] = sql_views(sql)
            return f

        return keep

    def sql(self, name: str, text: str, oracle: str | None = None) -> None:
        """Register a query that is SQL text over tables and views in braces; `oracle` only where the dialects differ."""
        self.query(name, oracle or text)(lambda t: t.sql(text))
