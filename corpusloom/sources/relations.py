"""Relational tables and queries as sources: reading, documents, catalog and table profiles, source specs."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.operators.tables import markdown_blocks
from corpusloom.settings import DEFAULTS


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def jdbc_table(
    spark: SparkSession, url: str, table: str, options: dict[str, str] | None = None, max_rows: int | None = None, schema: str | None = None
) -> DataFrame:
    """A table of a database, whole unless ``max_rows`` is given.

    Give partitionColumn, bounds and numPartitions in the options to read in parallel.
    """
    name = quoted(table) if schema is None else f"{quoted(schema)}.{quoted(table)}"
    df = spark.read.format("jdbc").options(url=url, dbtable=name, **(options or {})).load()
    return df if max_rows is None else df.limit(max_rows)


def jdbc_query(spark: SparkSession, url: str, sql: str, options: dict[str, str] | None = None) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=sql, **(options or {})).load()


def label_queries(frames: dict[str, DataFrame], row_key: str, columns: dict[str, list[str]], block_rows: int = DEFAULTS.block_rows) -> DataFrame:
    """Results of labelled queries as documents (source, doc_type, block, text).  Empty results give no document."""
    parts = []
    for label, df in frames.items():
        parts.append(
            markdown_blocks(df, label, columns[label], row_key, block_rows).select(
                F.concat(F.lit("query:"), "label").alias("source"), F.lit("db_query").alias("doc_type"), "block",
                F.col("content").alias("text"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def table_documents(df: DataFrame, label: str, columns: list[str], order: str, block_rows: int = DEFAULTS.block_rows) -> DataFrame:
    return markdown_blocks(df, label, columns, order, block_rows).select(
        F.concat(F.lit("table:"), "label").alias("source"), F.lit("db_table").alias("doc_type"), "block",
        F.col("content").alias("text"),
    )


def source_kind(spec: str) -> str:
    """folder, tables or several sources, by the shape of a source spec."""
    spec = spec.strip()
    if "|" in spec:
        return "hybrid"
    return "tables" if re.match(r"postgres(ql)?://", spec) else "folder"


def source_parts(spec: str) -> list[tuple[str, str]]:
    return [(p.strip(), source_kind(p)) for p in spec.split("|") if p.strip()]


def corpus_of(spec: str, readers: dict[str, callable]) -> DataFrame:
    """Union of the documents of all parts of a spec; ``readers`` maps a kind to a function of the part."""
    frames = [readers[kind](part) for part, kind in source_parts(spec)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def catalog_profile(tables: DataFrame, columns: DataFrame, keys: DataFrame, max_tables: int | None = None) -> DataFrame:
    """Tables by name (all, or the first ones) with their columns: type, nullability and whether part of the primary key.

    tables (table, row_count), columns (table, ordinal, column, type, nullable), keys (table, column).
    """
    first = tables if max_tables is None else tables.orderBy("table").limit(max_tables)
    marked = keys.select("table", "column").distinct().withColumn("primary_key", F.lit(True))
    return (
        columns.join(first, "table")
        .join(marked, ["table", "column"], "left")
        .select("table", F.greatest(F.col("row_count"), F.lit(0)).alias("row_count"), "ordinal", "column", "type", "nullable",
                F.coalesce("primary_key", F.lit(False)).alias("primary_key"))
    )


def catalog_frames(frames: dict[str, DataFrame], keys: dict[str, list[str]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three catalog frames for frames at hand: one count per table, the rest from the schemas."""
    spark = next(iter(frames.values())).sparkSession
    counts = reduce(
        DataFrame.unionByName,
        [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table"), "row_count") for n, df in frames.items()],
    )
    columns = [(n, i, f.name, f.dataType.simpleString(), f.nullable) for n, df in frames.items() for i, f in enumerate(df.schema, 1)]
    pairs = [(n, c) for n, cs in keys.items() for c in cs]
    return (
        counts,
        spark.createDataFrame(columns, "table string, ordinal int, column string, type string, nullable boolean"),
        spark.createDataFrame(pairs, "table string, column string"),
    )


def table_profile(frames: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """Row count and one sample row (that of the smallest key) per table."""
    parts = []
    for name, df in frames.items():
        record = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
        parts.append(
            df.agg(F.count(F.lit(1)).alias("row_count"), F.min_by(record, keys[name]).alias("sample")).select(
                F.lit(name).alias("table"), "row_count", "sample"
            )
        )
    return reduce(DataFrame.unionByName, parts)
