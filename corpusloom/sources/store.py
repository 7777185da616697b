"""Persisted collections and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.operators import lexical
from corpusloom.settings import DEFAULTS, Settings

TABLES = ("chunks", "postings", "terms")


def save_collections(chunks: DataFrame, folder: str, settings: Settings = DEFAULTS) -> None:
    """Write chunks (with vectors, if any), postings and term weights, one partition per collection.

    Only the collections present in ``chunks`` are replaced.  Rows are spread
    over files within a collection, so one large collection is written by many tasks.
    """
    tokens = lexical.tokenised(chunks)
    frames = {
        "chunks": chunks,
        "postings": lexical.postings(tokens).sortWithinPartitions("collection", "term"),  # readers skip row groups of other terms
        "terms": lexical.term_weights(lexical.term_documents(tokens), settings),
    }
    for name, df in frames.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(f"{folder}/{name}")


def load_collections(spark: SparkSession, folder: str, name: str, collections: list[str] | None = None) -> DataFrame:
    df = spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}")
    return df if collections is None else df.filter(F.col("collection").isin(*collections))


def drop_collections(spark: SparkSession, folder: str, target: str, collections: list[str]) -> None:
    """Write all tables without the named collections to another folder; the reader then switches to it."""
    for name in TABLES:
        kept = load_collections(spark, folder, name).filter(~F.col("collection").isin(*collections))
        kept.write.mode("overwrite").partitionBy("collection").parquet(f"{target}/{name}")


def score_saved(questions: DataFrame, folder: str, k: int, collections: list[str] | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Best chunks per question and collection from the stored index, without reading any text."""
    spark = questions.sparkSession
    return lexical.bm25_from_index(
        questions, load_collections(spark, folder, "postings", collections), load_collections(spark, folder, "terms", collections),
        k, settings,
    )


def write_csv(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(folder)


def write_lines(lines: DataFrame, folder: str) -> None:
    """Clean chat export: one folder per source; the lines of a source stay in order within its files."""
    ordered = lines.repartitionByRange("source", "seq").sortWithinPartitions("source", "seq")
    ordered.select("source", "line").write.mode("overwrite").partitionBy("source").text(folder)
