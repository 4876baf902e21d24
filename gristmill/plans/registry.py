"""Registry of the named queries, each next to its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gristmill.sources import readers

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


class Tables:
    """The parquet tables of one folder, read when first named."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))

    def spread(self, name: str, key: str) -> DataFrame:
        """The table for work that is heavy per row, split to use all cores."""
        return readers.spread(getattr(self, name), key)

    def named(self, *names: str) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in names}


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    oracle: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


REGISTRY: dict[str, Query] = {}


def query(ids: str, oracle: str | None = None) -> Callable:
    """Register ``build(tables)`` under its own name.

    ``ids`` lists the inventory items it covers, ``oracle`` is the same result
    in DuckDB SQL (None where SQL cannot express it at full size).
    """

    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        name = build.__name__
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, tuple(ids.split()), build, oracle)
        return build

    return add
