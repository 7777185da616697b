"""Registered queries: each has a Spark form and, where SQL can express it, an ANSI SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.operators.sizing import spread

# tables of long texts, whose few files would otherwise be worked on by few cores
TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Lazy access to the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(df, TEXT_KEYS[name]) if name in TEXT_KEYS else df


def query(name: str, sql: str | None = None):
    """Register ``f(tables) -> DataFrame`` under a name, with its SQL form."""

    def keep(f):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return f

    return keep
