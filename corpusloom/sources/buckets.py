"""Keyed tables in bucket folders: a batch of changes reads and writes only the buckets that hold its keys.

A key belongs to the bucket that its hash names.  Every change writes the new
rows of the buckets it touches into a folder of its own and then publishes a
manifest that names the valid folder of each bucket.  A change that fails before
that leaves the table as it was; files of other buckets are never touched.

The number of buckets is chosen when the table is made, so that one bucket is a
fair piece of work.  Keys may repeat (child tables); a bucket with a very
frequent key is written by several tasks.  Rows with a null key have a bucket
too; an upsert treats null as a key, a deletion never matches it.  One writer
at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from corpusloom.operators import upkeep
from corpusloom.operators.sizing import cut_lineage

BUCKET, STATE = "stored_bucket", "stored_state"
MANIFEST = "bucket int, state long, buckets int, key string, layout string"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _published(spark: SparkSession, folder: str) -> list:
    """The newest manifest: one line per bucket."""
    every = spark.read.schema(MANIFEST + ", published long").parquet(f"{folder}/manifests")
    newest = every.agg(F.max("published")).first()[0]
    return every.filter(F.col("published") == newest).collect()


def _write(rows: DataFrame, folder: str, state: int, key: str, buckets: int) -> None:
    made = rows.withColumn(BUCKET, bucket_of(F.col(key), buckets))
    made.hint("rebalance", F.col(BUCKET)).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{folder}/rows/{STATE}={state}")


def _publish(spark: SparkSession, folder: str, state: int, lines: list[tuple]) -> None:
    spark.createDataFrame(lines, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifests/published={state}")


def save(rows: DataFrame, folder: str, key: str, buckets: int) -> None:
    """A new table in an empty folder."""
    _write(rows, folder, 0, key, buckets)
    layout = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]).json()
    _publish(rows.sparkSession, folder, 0, [(b, 0, buckets, key, layout) for b in range(buckets)])


def _read(spark: SparkSession, folder: str, lines: list) -> DataFrame:
    """Rows of the named buckets; Spark prunes all other folders."""
    layout = T.StructType.fromJson(json.loads(lines[0]["layout"]))
    by: dict[int, list[int]] = {}
    for r in lines:
        by.setdefault(r["state"], []).append(r["bucket"])
    full = T.StructType([*layout.fields, T.StructField(STATE, T.LongType()), T.StructField(BUCKET, T.IntegerType())])
    df = spark.read.schema(full).option("basePath", f"{folder}/rows").parquet(*[f"{folder}/rows/{STATE}={s}" for s in sorted(by)])
    valid = F.lit(False)
    for s, names in sorted(by.items()):
        valid = valid | ((F.col(STATE) == s) & F.col(BUCKET).isin(names))
    return df.filter(valid).select(*layout.names)


def load(spark: SparkSession, folder: str, keys: list | None = None) -> DataFrame:
    """The table, or its rows with some keys, for which only their buckets are read."""
    lines = _published(spark, folder)
    if keys is None:
        return _read(spark, folder, lines)
    key = lines[0]["key"]
    kind = _read(spark, folder, lines).schema[key].dataType
    asked = spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField("k", kind)]))
    wanted = {r[0] for r in asked.select(bucket_of(F.col("k"), lines[0]["buckets"])).distinct().collect()}
    some = [r for r in lines if r["bucket"] in wanted]
    return (_read(spark, folder, some) if some else _read(spark, folder, lines).limit(0)).filter(F.col(key).isin(keys))


def changed(batch: DataFrame, folder: str, change: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """Replace the buckets of the keys in ``batch`` by ``change(stored rows of these buckets, batch)``; gives the numbers of the buckets."""
    spark = batch.sparkSession
    lines = _published(spark, folder)
    key, buckets = lines[0]["key"], lines[0]["buckets"]
    kind = _read(spark, folder, lines).schema[key].dataType
    batch = cut_lineage(batch.withColumn(key, F.col(key).cast(kind)))
    touched = {r[0] for r in batch.select(bucket_of(F.col(key), buckets)).distinct().collect()}
    if not touched:
        return []
    stored = _read(spark, folder, [r for r in lines if r["bucket"] in touched])
    rows = change(stored, batch)
    rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in stored.schema])
    state = 1 + max(r["published"] for r in lines)
    _write(rows, folder, state, key, buckets)
    _publish(spark, folder, state, [(r["bucket"], state if r["bucket"] in touched else r["state"], buckets, key, r["layout"]) for r in lines])
    return sorted(touched)


def upsert(incoming: DataFrame, folder: str, replace: list[str], version: str = "updated_at") -> list[int]:
    """Insert or replace by key as in ``upkeep.upserted``."""
    key = _published(incoming.sparkSession, folder)[0]["key"]
    return changed(incoming, folder, lambda stored, batch: upkeep.upserted(stored, batch, key, replace, version))


def delete(keys: DataFrame, folder: str) -> list[int]:
    """Delete all rows with the keys of a frame."""
    key = _published(keys.sparkSession, folder)[0]["key"]
    return changed(keys.select(key), folder, lambda stored, batch: upkeep.deleted(stored, batch, key))


def replace_children(fresh: DataFrame, folder: str) -> list[int]:
    """All rows with a key of ``fresh`` are replaced by the fresh ones."""
    key = _published(fresh.sparkSession, folder)[0]["key"]
    return changed(fresh, folder, lambda stored, batch: upkeep.children_replaced(stored, batch, key))
