"""Named queries over a table directory, each with an optional SQL twin for checking."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


class Tables:
    """Lazy access to the parquet tables of one directory: ``t.orders``, ``t.sql("... {orders} ...")``."""

    def __init__(self, spark: SparkSession, directory: str, rows_per_range: int | None = None):
        self.spark = spark
        self.directory = str(directory).rstrip("/")
        self.rows_per_range = rows_per_range

    def in_ranges(self, rows: int) -> Tables:
        """The same tables, with every order cut into ranges of about so many rows."""
        return Tables(self.spark, self.directory, rows)

    def path(self, name: str) -> str:
        return f"{self.directory}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))

    def sql(self, template: str) -> DataFrame:
        """Run SQL that names tables in braces, for example ``SELECT * FROM {orders}``."""
        used = [n for n in TABLES if "{" + n + "}" in template]
        return self.spark.sql(template, **{n: getattr(self, n) for n in used})


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Tables], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def plain_sql(template: str) -> str:
    """The same SQL with table names instead of brace markers."""
    for name in TABLES:
        template = template.replace("{" + name + "}", name)
    return template


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, fn, plain_sql(oracle) if oracle else None)
        return fn
    return register
