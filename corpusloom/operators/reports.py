"""Tables over score rows: scenario means, summaries, ablation steps, pivots and renumbering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.operators.ordering import numbered

SUMMARY = [
    "retrieval_relevance", "answer_faithfulness", "answer_completeness", "rouge_l", "bleu_1",
    "precision_at_k", "mrr", "context_coverage", "overall", "kte", "msrs", "aqi",
]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def means(rows: DataFrame, by: list[str], columns: list[str] | None = None, digits: int = 3) -> DataFrame:
    aggs = [F.round(F.avg(c), digits).alias(c) for c in columns or SUMMARY]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def summary(rows: DataFrame, by: list[str], digits: int = 3) -> DataFrame:
    """Row count, mean overall and the composites of the means."""
    m = lambda c: F.avg(c)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(m("overall"), digits).alias("overall"),
        F.round((m("answer_faithfulness") + m("answer_completeness")) / 2, digits).alias("kte"),
        F.round((m("precision_at_k") + m("context_coverage")) / 2, digits).alias("msrs"),
        F.round((m("answer_faithfulness") + m("answer_completeness") + m("rouge_l")) / 3, digits).alias("aqi"),
    )


def ablation(configurations: DataFrame, order: str = "step", value: str = "kte") -> DataFrame:
    """Change from one configuration to the next and its running sum.

    There is one row per configuration, so the window without a partition is small.
    """
    w = Window.orderBy(order)
    change = F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0.0))
    return configurations.withColumn("delta", F.round(change, 3)).withColumn(
        "cumulative", F.round(F.col(value) - F.first(value).over(w), 3)
    )


def dominant(steps: DataFrame, name: str = "scenario", first_step: int = 2, order: str = "step") -> DataFrame:
    """Configuration with the largest change, from the given step on; the earlier one on a tie."""
    return steps.filter(F.col(order) >= first_step).agg(
        F.max_by(name, F.struct("delta", (-F.col(order)).alias("o"))).alias("dominant")
    )


def pivot_scenarios(rows: DataFrame, scenarios: list[str], value: Column) -> DataFrame:
    return rows.groupBy("question_id").pivot("scenario", scenarios).agg(F.first(value))


def renumbered(rows: DataFrame, order: str = "no", out: str = "new_no") -> DataFrame:
    """Number all rows from 1, scenario by scenario, without sorting them in one task."""
    placed = numbered(rows, ["scenario"], order, "__n")
    counts = rows.groupBy("scenario").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy("scenario").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("scenario", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    return placed.join(starts, "scenario").withColumn(out, F.col("__start") + F.col("__n")).drop("__n", "__start")
