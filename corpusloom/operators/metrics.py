"""Quality metrics of answers and of the chunks they rest on, one row per question.

questions (question_id, text, vec)
hits      (question_id, rank, content, source, score, vec), at most k rows per question
answers   (question_id, answer, gold); gold may be null, a null answer marks a failed question
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusloom.functions import kernels
from corpusloom.functions.text import strip
from corpusloom.functions.words import eval_tokens
from corpusloom.settings import DEFAULTS, Settings

METRICS = [
    "retrieval_relevance", "answer_faithfulness", "answer_completeness", "rouge_l", "bleu_1",
    "precision_at_k", "mrr", "context_coverage", "overall", "avg_chunk_score",
]
COMPOSITES = ["kte", "msrs", "aqi"]


def overlap(left: Column, right: Column) -> Column:
    """Subsequence length and clipped token matches of two token lists."""
    kind = T.StructType([T.StructField("lcs", T.IntegerType()), T.StructField("clipped", T.IntegerType())])

    def body(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return kernels.token_overlap(a, b)

    return F.pandas_udf(body, kind)(left, right)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def mean_vector(vectors: Column) -> Column:
    """Mean of a short list of vectors."""
    total = F.aggregate(
        F.slice(vectors, 2, F.greatest(F.size(vectors) - 1, F.lit(0))),
        F.transform(vectors[0], lambda x: x.cast("double")),
        lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y.cast("double")),
    )
    return F.transform(total, lambda x: x / F.size(vectors))


def f_measure(common: Column, n_left: Column, n_right: Column) -> Column:
    p, r = common / n_right, common / n_left
    return F.when((n_left > 0) & (n_right > 0) & (common > 0), 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def contexts(hits: DataFrame, relevant: Column) -> DataFrame:
    """Per question: joined context, counts, first relevant rank.  Groups hold at most k rows."""
    return hits.groupBy("question_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), " "
        ).alias("context"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum(F.when(relevant, 1).otherwise(0)).alias("n_relevant"),
        F.min(F.when(relevant, F.col("rank"))).alias("first_relevant"),
        F.size(F.collect_set("source")).alias("n_sources"),
        F.avg("score").alias("mean_score"),
        F.collect_list("vec").alias("vectors"),
    )


def hit_metrics(hits: DataFrame, k: int, relevant: Column, digits: int = 6) -> DataFrame:
    """Precision at k, reciprocal rank, source coverage and mean score of every question's hits."""
    return hits.groupBy("question_id").agg(
        F.round(F.sum(relevant.cast("int")) / k, digits).alias("precision_at_k"),
        F.round(F.coalesce(1.0 / F.min(F.when(relevant, F.col("rank"))), F.lit(0.0)), digits).alias("mrr"),
        F.round(F.size(F.collect_set("source")) / F.count(F.lit(1)), digits).alias("context_coverage"),
        F.round(F.avg("score"), digits).alias("avg_chunk_score"),
    )


def text_metrics(pairs: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """Token metrics of an answer ``hyp`` against ``ref``, which stands for context, question and gold alike."""
    rows = (
        pairs.select(*keys, eval_tokens(F.col("hyp")).alias("a"), eval_tokens(F.col("ref")).alias("r"))
        .withColumn("o", overlap(F.col("a"), F.col("r")))
        .withColumn("as", F.array_distinct("a"))
        .withColumn("rs", F.array_distinct("r"))
        .withColumn("common", F.size(F.array_intersect("as", "rs")))
    )
    m, n = F.size("a"), F.size("r")
    penalty = F.when(m >= n, F.lit(1.0)).otherwise(F.exp(1 - n / m))
    return rows.select(
        *keys,
        F.round(f_measure(F.col("common"), F.size("as"), F.size("rs")), digits).alias("faithfulness"),
        F.round(F.when(F.size("rs") > 0, F.col("common") / F.size("rs")).otherwise(0.0), digits).alias("completeness"),
        F.round(f_measure(F.col("o.lcs"), m, n), digits).alias("rouge_l"),
        F.round(F.when((m > 0) & (n > 0), penalty * F.col("o.clipped") / m).otherwise(0.0), digits).alias("bleu_1"),
    )


def score_answers(
    questions: DataFrame, hits: DataFrame, answers: DataFrame, k: int | None = None,
    relevant: Column | None = None, settings: Settings = DEFAULTS,
) -> DataFrame:
    """All metrics, rounded to three decimals.  ``relevant`` defaults to score >= threshold."""
    k = k or settings.top_k
    relevant = F.col("score") >= settings.similarity_threshold if relevant is None else relevant
    rows = (
        questions.join(answers, "question_id", "left")
        .join(contexts(hits, relevant), "question_id", "left")
        .select(
            "question_id", "answer", "gold", "vec", "vectors", "n_relevant", "first_relevant", "n_sources", "mean_score",
            F.coalesce("n_chunks", F.lit(0)).alias("chunks"),
            eval_tokens(F.col("text")).alias("q"),
            eval_tokens(F.coalesce("answer", F.lit(""))).alias("a"),
            eval_tokens(F.coalesce("context", F.lit(""))).alias("c"),
            (strip(F.coalesce("answer", F.lit(""))) != "").alias("answered"),
            eval_tokens(F.coalesce(F.nullif(F.col("gold"), F.lit("")), "context", F.lit(""))).alias("ref"),
        )
        .withColumn("o", overlap(F.col("a"), F.col("ref")))
        .withColumn("qs", F.array_distinct("q"))
        .withColumn("as", F.array_distinct("a"))
        .withColumn("cs", F.array_distinct("c"))
    )
    m, n = F.size("a"), F.size("ref")
    common = F.size(F.array_intersect("as", "cs"))
    penalty = F.when(m >= n, F.lit(1.0)).otherwise(F.exp(1 - n / m))
    scored = rows.select(
        "question_id", "answer", "gold", "chunks",
        F.when(F.col("chunks") == 0, 0.0)
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(F.col("vec"), mean_vector(F.col("vectors"))))))
        .alias("retrieval_relevance"),
        F.when((F.col("chunks") == 0) | ~F.col("answered"), 0.0)
        .otherwise(f_measure(common, F.size("as"), F.size("cs"))).alias("answer_faithfulness"),
        F.when(F.col("answered") & (F.size("qs") > 0), F.size(F.array_intersect("qs", "as")) / F.size("qs"))
        .otherwise(0.0).alias("answer_completeness"),
        f_measure(F.col("o.lcs"), m, n).alias("rouge_l"),
        F.when((m > 0) & (n > 0), penalty * F.col("o.clipped") / m).otherwise(0.0).alias("bleu_1"),
        (F.coalesce("n_relevant", F.lit(0)) / k).alias("precision_at_k"),
        F.coalesce(1.0 / F.col("first_relevant"), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.col("n_sources") / F.col("chunks"), F.lit(0.0)).alias("context_coverage"),
        F.coalesce("mean_score", F.lit(0.0)).alias("avg_chunk_score"),
    )
    primary = ["retrieval_relevance", "answer_faithfulness", "answer_completeness", "rouge_l", "bleu_1"]
    scored = scored.withColumn("overall", sum((F.col(c) for c in primary[1:]), F.col(primary[0])) / 5)
    failed = F.col("answer").isNull()
    return scored.select(
        "question_id",
        *[F.when(failed, 0.0).otherwise(F.round(c, 3)).alias(c) for c in METRICS],
        F.when(failed, 0).otherwise(F.col("chunks")).cast("long").alias("chunks"),
        F.coalesce("answer", F.lit("")).alias("answer"),
        F.coalesce("gold", F.lit("")).alias("gold"),
    )


def overall_of_three(df: DataFrame) -> Column:
    """Shorter mean used for fresh reads: relevance, faithfulness and completeness."""
    return (F.col("retrieval_relevance") + F.col("answer_faithfulness") + F.col("answer_completeness")) / 3


def with_composites(df: DataFrame) -> DataFrame:
    c = F.col
    return df.select(
        "*",
        F.round((c("answer_faithfulness") + c("answer_completeness")) / 2, 4).alias("kte"),
        F.round((c("precision_at_k") + c("context_coverage")) / 2, 4).alias("msrs"),
        F.round((c("answer_faithfulness") + c("answer_completeness") + c("rouge_l")) / 3, 4).alias("aqi"),
    )


def grade(c: Column) -> Column:
    return F.when(c >= 0.7, "[BAIK]").when(c >= 0.4, "[CUKUP]").otherwise("[RENDAH]")
