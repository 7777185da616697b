"""Context strings for answering, and what they are made of.  Groups hold the few used hits of a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom import lexicon
from corpusloom.functions.text import snippet

SEPARATOR = "\n\n---\n\n"


def in_order(block: Column, separator: str = SEPARATOR) -> Column:
    return F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("rank"), block.alias("block")))), lambda x: x["block"]),
        separator,
    )


def base_name(c: Column) -> Column:
    return F.when(c.rlike("^(table|query):"), c).otherwise(F.regexp_extract(c, r"([^/]*)/*$", 1))


def source_block() -> Column:
    return F.concat(
        F.lit("[Source "), F.col("rank").cast("string"), F.lit(" — "), base_name(F.col("source")), F.lit(" ("),
        F.col("doc_type"), F.lit(")]:\n"), F.col("content"),
    )


def scored_block() -> Column:
    """Block with page (counted from 0) and score."""
    page = F.coalesce(F.concat(F.lit(", Halaman "), (F.col("page") + 1).cast("string")), F.lit(""))
    return F.concat(
        F.lit("[Sumber "), F.col("rank").cast("string"), F.lit(": "), base_name(F.col("source")), page,
        F.lit(" | Skor: "), F.format_string("%.3f", F.col("score")), F.lit("]\n"), F.col("content"),
    )


def typed_block() -> Column:
    label = F.when(F.col("type") == "pdf", "Document").when(F.col("type") == "chat", "Chat").when(
        F.col("type") == "database", "Database"
    ).otherwise("Source")
    return F.concat(F.lit("["), label, F.lit(" "), F.col("rank").cast("string"), F.lit("]:\n"), F.substring("content", 1, 500))


def merged_block(question: Column | None = None) -> Column:
    """Block of a merged result; with a question the small form: its snippet, 150 characters."""
    table = F.col("type").isin(*lexicon.TABLE_TYPES)
    if question is None:
        body, limit = F.col("content"), F.when(table, 6000).otherwise(2000)
    else:
        body, limit = snippet(F.col("content"), question), F.lit(150)
    cut = F.when(F.length(body) > limit, F.concat(F.substring(body, F.lit(1), limit), F.lit("..."))).otherwise(body)
    return F.concat(F.lit("[Sumber "), F.col("rank").cast("string"), F.lit(" — "), F.col("source"), F.lit("]:\n"), cut)


def build(hits: DataFrame, block: Column, top: int | None = None) -> DataFrame:
    used = hits if top is None else hits.filter(F.col("rank") <= top)
    return used.groupBy("question_id").agg(in_order(block).alias("context"))


def breakdown(merged: DataFrame, top: int = 8, threshold: float = 0.18) -> DataFrame:
    """Counts per type among the used results, and whether the best one calls for direct extraction."""
    used = merged.filter(F.col("rank") <= top)
    types = list(lexicon.CONFIDENCE)
    counts = used.groupBy("question_id").agg(
        *[F.sum((F.col("type") == t).cast("int")).cast("long").alias(t) for t in types],
        F.max(F.when(F.col("rank") == 1, F.col("confidence"))).alias("top_confidence"),
        F.max(F.when(F.col("rank") == 1, F.col("type"))).alias("top_type"),
        F.sum((F.col("type").isin("chat", "database") & (F.col("rank") <= 3)).cast("int")).alias("others"),
    )
    return counts.select(
        "question_id", *types, "top_confidence",
        ((F.col("top_confidence") < threshold) & (F.col("top_type") == "pdf") & (F.col("others") == 0)).alias("direct"),
    )
