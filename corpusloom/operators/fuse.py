"""Reciprocal rank fusion of dense and lexical rankings, with a per-source cap and a lexical slot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.operators.sizing import small
from corpusloom.settings import DEFAULTS, Settings


def lexical_pool(k: int) -> int:
    return max(3 * k, 10)


def contributions(dense: DataFrame, lexical: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Both rankings as one frame: source order, rank, share of the fused score and shown similarity.

    A lexical hit shows the least similarity among the dense hits of its question
    and collection, 0.1 at least.  It is taken after the union, so neither
    ranking is computed twice.
    """
    by = ["question_id", "collection"]
    own = Window.partitionBy(*by)
    none = F.lit(None).cast("double")
    both = dense.select(*by, "chunk_id", F.lit(0).alias("origin"), "rank", "similarity").unionByName(
        lexical.select(*by, "chunk_id", F.lit(1).alias("origin"), "rank", none.alias("similarity")))
    least = both.withColumn("floor", F.greatest(F.min("similarity").over(own), F.lit(0.1)))
    return least.select(
        *by, "chunk_id", "origin", "rank", (1.0 / (settings.rrf_k + F.col("rank"))).alias("share"),
        F.when(F.col("origin") == 0, F.col("similarity")).otherwise(F.col("floor")).alias("shown"))


def fuse(dense: DataFrame, lexical: DataFrame, chunks: DataFrame, k: int | DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Fused ranking of ``dense`` (.., chunk_id, rank, similarity) and ``lexical`` (.., chunk_id, rank).

    ``chunks`` (collection, chunk_id, source) supplies the source of each hit; no
    text is moved.  Every window below runs over the candidates of one question
    and collection, at most k + max(3k, 10) rows.  ``k`` may differ by question: (question_id, k).
    """
    by = ["question_id", "collection"]
    side = small(contributions(dense, lexical, settings), settings)
    described = chunks.select("collection", "chunk_id", "source").join(side, ["collection", "chunk_id"])
    first = F.struct("origin", "rank", "source", "shown")
    fused = (
        described.groupBy(*by, "chunk_id")
        .agg(
            F.round(F.sum("share"), 9).alias("fused"),
            F.min(first).alias("first"),
            F.min(F.when(F.col("origin") == 1, F.col("rank"))).alias("lexical_rank"),
        )
        .select(*by, "chunk_id", "fused", "lexical_rank", "first.*")
    )
    order = [F.desc("fused"), F.asc("origin"), F.asc("rank"), F.asc("chunk_id")]
    per_source = Window.partitionBy(*by, "source").orderBy(*order)
    everything = Window.partitionBy(*by).orderBy("over", *order)
    placed = (
        fused.withColumn("over", (F.row_number().over(per_source) > settings.per_source_cap).cast("int"))
        .withColumn("place", F.row_number().over(everything))
    )
    several = isinstance(k, DataFrame)
    most = F.col("k") if several else F.lit(k)
    if several:
        placed = placed.join(small(k, settings), "question_id")
    if several or k > 1:
        # the best lexical hit takes the last place when it is not among the first k
        placed = placed.withColumn(
            "place",
            F.when((most > 1) & (F.col("lexical_rank") == 1) & (F.col("place") > most), most).otherwise(
                F.col("place")
                + F.when(
                    (most > 1) & (F.col("place") == most)
                    & (F.max(F.when(F.col("lexical_rank") == 1, F.col("place"))).over(Window.partitionBy(*by)) > most),
                    F.lit(1),
                ).otherwise(F.lit(0))
            ),
        )
    return placed.filter(F.col("place") <= most).select(
        *by, "place", "chunk_id", "source", F.round("shown", 6).alias("shown"), "fused"
    )
