"""Shared Spark helpers: written intermediates, checked broadcasts, joins that split hot keys."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.operators.sizing import size_in_bytes

BROADCAST_BYTES = 64 << 20
BATCH_BYTES = 2 << 20
SALTS = 64


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one in the warehouse only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or spark.conf.get("spark.sql.warehouse.dir") + "/_intermediate"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows go to Python in batches of about ``BATCH_BYTES`` in the jobs that run inside, so that long texts and lists do not add up to 10,000 rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame) -> DataFrame:
    """The frame as Parquet in the shared folder: lineage ends here and every later reader sees the same rows."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(*frames: DataFrame) -> None:
    """Delete the folders of written frames that nothing reads any more: all that was made of them has itself been written."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a written frame for broadcasting if its measured size allows it, else leave it to a shuffle."""
    return F.broadcast(df) if size_in_bytes(df) <= most else df


def spread_join(df: DataFrame, table: DataFrame, key: str, by: Column, salts: int = SALTS) -> DataFrame:
    """Left join with a table unique on ``key``, where one key may hold any share of the rows of ``df``.

    The table is copied only to the salts that occur with a key, so a rare key
    is not replicated and a hot one is split over ``salts`` tasks.
    """
    salted = df.withColumn("_salt", F.pmod(by, F.lit(salts)).cast("int"))
    copies = salted.select(key, "_salt").distinct().join(table, key)
    return salted.join(copies, [key, "_salt"], "left").drop("_salt")


def text_of(df: DataFrame, name: str = "text") -> Column:
    """A text column by exact name, null as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))
