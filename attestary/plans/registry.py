"""Named plans over the analytics tables, each with the SQL that must give the same rows.

The tables hold no dossiers, so every operator runs on the table of the same shape. ``shape`` is
the SQL that brings a table into an operator's input form; it is plain enough to be read by Spark
and by the checking engine alike, so both start from the same rows and only the operator differs.
"""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter

from pyspark.sql import DataFrame, SparkSession

from attestary.session import bound_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


class Source:
    """The tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def shape(self, sql: str) -> DataFrame:
        names = {n for _, n, _, _ in Formatter().parse(sql) if n}
        return self.spark.sql(sql, **{n: self.table(n) for n in names})


def plain(sql: str) -> str:
    """The shaping SQL with bare table names."""
    return sql.format(**{t: t for t in TABLES})


def query(name: str, sql: str | None = None):
    """Register a plan; ``sql`` holds the expected rows, ``None`` where SQL cannot express them."""
    def add(fn: Callable[[Source], DataFrame]) -> Callable[[Source], DataFrame]:
        QUERIES[name] = lambda spark, folder: fn(Source(bound_batches(spark), folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add
