"""Collects queries and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        """Register a function (tables) -> DataFrame under its name; ``tables`` reads a table by attribute."""

        def register(f: Callable) -> Callable:
            self.queries[f.__name__] = lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))
            if sql:
                self.sql[f.__name__] = sql
            return f

        return register


class Tables:
    """Attribute access to the tables of a folder; ``once`` gives a table without repeated rows."""

    def __init__(self, spark, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str):
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def once(self, name: str):
        return getattr(self, name).distinct()
