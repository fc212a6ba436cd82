"""Registration of queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from shelfmark.session import tune
from workload.views import oracle, view


class Source:
    """What a query reads: views and tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(source) -> DataFrame`` under ``name`` for inventory IDs ``covers``."""

    def register(fn: Callable[[Source], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Source(tune(spark), sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, covers, run, None if sql is None else oracle(sql))
        return fn

    return register
