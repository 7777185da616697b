"""Exact dense top-k for many questions, without ever forming all pairs as rows.

Questions are packed into byte blocks and given to the tasks in slices of a bounded
size.  Vectors meet all blocks of a slice where they were read, without being
copied; a kernel emits only the k nearest per question of each task, and a window
keeps the k best.  Questions with equal vectors are searched once.
"""

from __future__ import annotations

from functools import reduce
from math import sqrt

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from corpusloom.functions import kernels
from corpusloom.operators.sizing import best, cut_lineage, small
from corpusloom.settings import DEFAULTS, Settings


def similarity(distance: Column) -> Column:
    return 1.0 / (1.0 + distance)


def relevance(distance: Column) -> Column:
    """Other score form; negative for far vectors."""
    return 1.0 - distance / sqrt(2.0)


def distinct_vectors(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, question_id) of every row of the questions, and the (id, vec) that are to be searched."""
    rows = questions.select("question_id", "vec").withColumn("__row", F.monotonically_increasing_id())
    rows = cut_lineage(rows.withColumn("id", F.min("__row").over(Window.partitionBy("vec"))))
    return rows.select("id", "question_id"), rows.filter(F.col("id") == F.col("__row")).select("id", "vec")


def owned(hits: DataFrame, owners: DataFrame, k: int, settings: Settings = DEFAULTS) -> DataFrame:
    """Hits of distinct vectors, given to the questions that have them; k per question and collection."""
    named = hits.withColumnRenamed("question_id", "id").drop("rank").join(small(owners, settings), "id").drop("id")
    return best(named, ["question_id", "collection"], [F.asc("distance"), F.asc("chunk_id")], k).select(
        "question_id", "collection", "chunk_id", "distance", "rank")


def nearest(
    questions: DataFrame, chunks: DataFrame, k: int, dim: int = DEFAULTS.vector_dim, settings: Settings = DEFAULTS
) -> DataFrame:
    """questions (question_id long, vec), chunks (collection, chunk_id long, vec)

    gives (question_id, collection, chunk_id, distance, rank): the k nearest per
    question and collection, by squared distance and then chunk.
    """
    kind = chunks.schema["collection"].dataType
    vectors = chunks.select("collection", F.col("chunk_id").alias("id"), "vec")
    owners, searched = distinct_vectors(questions)
    n_searched = searched.count()
    if alone := n_searched == owners.count():
        searched = questions.select(F.col("question_id").alias("id"), "vec")
    n_blocks = max(1, -(-n_searched // settings.question_block))
    asked = (
        searched.select(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block"), "id", "vec")
        .repartition(n_blocks, "block")
        .sortWithinPartitions("block")
        .mapInArrow(
            kernels.pack_vectors(["block"], settings.question_block),
            T.StructType(
                [T.StructField("block", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("mat", T.BinaryType())]
            ),
        )
    )
    asked = cut_lineage(asked)
    shape = T.StructType(
        [
            T.StructField("question_id", T.LongType()),
            T.StructField("collection", kind),
            T.StructField("chunk_id", T.LongType()),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    # a slice of question blocks holds about half of what a broadcast may, and is one pass over the vectors
    per_slice = max(1, settings.broadcast_bytes // (2 * settings.question_block * (4 * dim + 8)))
    context = questions.sparkSession.sparkContext
    passes = []
    for low in range(0, n_blocks, per_slice):
        rows = asked.filter(F.col("block").between(low, low + per_slice - 1)).select("ids", "mat").collect()
        held = context.broadcast([(bytes(r["ids"]), bytes(r["mat"])) for r in rows])
        passes.append(vectors.mapInArrow(kernels.nearest_to_held(held, k, "collection", dim), shape))
    found = reduce(DataFrame.unionByName, passes)
    hits = best(found, ["question_id", "collection"], [F.asc("distance"), F.asc("chunk_id")], k)
    return hits if alone else owned(hits, owners, k, settings)


def retrieve(
    questions: DataFrame, chunks: DataFrame, k: int | None = None, threshold: float | None = None,
    dim: int = DEFAULTS.vector_dim, settings: Settings = DEFAULTS,
) -> DataFrame:
    """Dense retrieval: 2k candidates, similarity threshold, four decimals, k best."""
    k = k or settings.top_k
    floor = settings.similarity_threshold if threshold is None else threshold
    return (
        nearest(questions, chunks, 2 * k, dim, settings)
        .filter((similarity(F.col("distance")) >= floor) & (F.col("rank") <= k))
        .withColumn("score", F.round(similarity(F.col("distance")), 4))
    )


def across_collections(hits: DataFrame, k: int) -> DataFrame:
    """Best k per question over all collections of per-collection hits."""
    return best(
        hits.drop("rank"), ["question_id"], [F.asc("distance"), F.asc("collection"), F.asc("chunk_id")], k
    )
