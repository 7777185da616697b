"""Incremental ingest: new files become chunks; a changed document replaces its former chunks.

Every micro-batch writes its own partition of the chunk table, and a repeated
batch overwrites only that partition, so a restart after a failure leaves no
duplicates.  Readers take the newest batch of every document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.chunking import chunks_of
from corpusloom.operators.sizing import small
from corpusloom.settings import DEFAULTS, Settings

VERSION_MARK = r"__v([0-9]+)(\.[^./]+)?$"


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """(source, version, changed, text) of text files as they appear.

    The source is the path below the folder without a version mark; the suffix stays, so ``a.txt`` and ``a.md`` are two documents.
    """
    raw = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder)
    path, base = F.col("_metadata.file_path"), folder.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    below = F.substring(path, F.instr(path, base) + len(base), F.length(path))
    version = F.coalesce(F.nullif(F.regexp_extract(below, VERSION_MARK, 1), F.lit("")).cast("long"), F.lit(0))
    return raw.select(
        F.regexp_replace(below, VERSION_MARK, "$2").alias("source"), version.alias("version"),
        F.col("_metadata.file_modification_time").alias("changed"), F.col("value").alias("text"))


def newest_of(batch: DataFrame) -> DataFrame:
    """One row per source: the highest version, then the latest change."""
    kept = F.max_by(F.struct("text"), F.struct("version", "changed", "text")).alias("row")
    return batch.groupBy("source").agg(kept, F.max("version").alias("version")).select("source", "version", "row.text")


def ingest(documents: DataFrame, table: str, checkpoint: str, settings: Settings = DEFAULTS) -> StreamingQuery:
    """Start a run over everything that has arrived; it stops when it has caught up.

    A document whose new text gives no chunk keeps a row without text, so that its former chunks do not come back.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = newest_of(batch)
        chunks = chunks_of(newest, settings.chunk_size, settings.chunk_overlap)
        marks = newest.filter(F.trim("text") == "").withColumn("text", F.lit(None).cast("string"))
        chunks.unionByName(marks, allowMissingColumns=True).withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch").parquet(table)

    return (
        documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current(spark: SparkSession, table: str) -> DataFrame:
    """Chunks of the newest version of every document; of equal versions, that of the newest batch."""
    every = spark.read.parquet(table)
    newest = every.groupBy("source").agg(F.max(F.struct("version", "batch")).alias("newest")).select("source", "newest.*")
    return every.join(small(newest), ["source", "version", "batch"]).filter(F.col("text").isNotNull()).drop("batch", "version")
