"""Whole plans from questions to answers, each one job over all questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from corpusloom import lexicon
from corpusloom.functions import questions as qf
from corpusloom.functions.text import checked_answer, degenerate, direct_answer, snippet
from corpusloom.operators import context, dense, merge, search, tables as tb
from corpusloom.operators.reports import union_all
from corpusloom.operators.sizing import cut_lineage, small
from corpusloom.plans import answering
from corpusloom.settings import DEFAULTS, Settings


def ask(
    questions: DataFrame, chunks: DataFrame, model: Callable[[str], str] | None = None,
    settings: Settings = DEFAULTS, embed=search.hashed,
) -> DataFrame:
    """Dense retrieval, numbered context and an answer per question.

    questions (question_id, text), chunks (collection, chunk_id, text, source, doc_type).
    Without a model the answer is the best chunk's snippet.  Questions without
    chunks keep their row and get the fixed answer; blank questions are dropped.
    """
    asked = questions.filter(F.trim("text") != "")
    near = dense.retrieve(embed(asked), embed(chunks), settings.top_k, dim=settings.vector_dim, settings=settings)
    hits = chunks.join(small(near.drop("distance"), settings), ["collection", "chunk_id"]).withColumnRenamed("text", "content")
    used = context.build(hits, context.source_block())
    if model is None:
        first = hits.filter(F.col("rank") == 1).join(asked, "question_id").select(
            "question_id", snippet(F.col("content"), F.col("text")).alias("answer")
        )
        answers = asked.join(used, "question_id", "left").join(first, "question_id", "left")
    else:
        ready = asked.join(used, "question_id").withColumn(
            "prompt", answering.prompt(F.lit("general"), F.col("context"), F.col("text"), F.lit(False))
        )
        made = answering.with_answers(ready.select("question_id", "prompt"), model).select("question_id", "answer")
        answers = asked.join(used, "question_id", "left").join(made, "question_id", "left")
    return answers.withColumn("answer", F.coalesce("answer", F.lit(answering.NO_DOCUMENTS)))


def weighted_questions(questions: DataFrame) -> DataFrame:
    """Questions with their intent flags, weight class and source weights."""
    flags = qf.intent_flags(F.col("text"))
    base = questions.select(
        "question_id", "text", *[c.alias(n) for n, c in flags.items()], qf.weight_class(F.col("text")).alias("kind")
    )
    return base.select("*", *[c.alias(n) for n, c in qf.weights_of(F.col("kind"), lexicon.INTENT_WEIGHTS).items()])


def _with_k(asked: DataFrame, weight: int, least: int, settings: Settings) -> DataFrame:
    """(question_id, text, k): how many hits the weight class of a question leads to; without those that it leads to none."""
    k = F
    for kind, weights in lexicon.INTENT_WEIGHTS.items():
        k = k.when(F.col("kind") == kind, F.lit(max(int(settings.k_per_collection * weights[weight]), least)))
    return asked.select("question_id", "text", k.alias("k")).filter(F.col("k") > 0)


def _fresh(asked: DataFrame, chunks: DataFrame, weight: str, kind: str, label: str, least: int, settings: Settings, embed) -> DataFrame:
    """Results of chunks read just now, such as public links or connected tables, under the weight of their class."""
    hits = search.search_fresh(asked.select("question_id", "text"), chunks, lambda c: c, max(settings.k_per_collection, least), settings, embed)
    found = chunks.select("collection", "chunk_id", F.col("text").alias("content")).join(
        small(hits.select("question_id", "collection", "chunk_id", "place", "source", "shown"), settings), ["collection", "chunk_id"])
    return found.join(asked.select("question_id", weight), "question_id").select(
        "question_id", F.lit(kind).alias("type"), F.col("place").cast("long").alias("item"), "content",
        F.concat(F.lit(label), "source").alias("source"), (F.col("shown") * F.col(weight)).alias("score"),
    )


def hybrid_results(
    questions: DataFrame, documents: DataFrame, tables: list[tb.Searchable], chats: DataFrame, chat_keywords: DataFrame,
    settings: Settings = DEFAULTS, embed=search.hashed, routes: dict[str, list[str]] | None = None, links: DataFrame | None = None,
    connected: DataFrame | None = None,
) -> DataFrame:
    """Weighted results of documents, tables, chats, links and connected tables: (question_id, type, item, content, source, score).

    ``routes`` names key words per table: a question searches the tables it is
    routed to, without routes all of them.  ``links`` and ``connected`` are
    chunks (collection, chunk_id, text, source).
    """
    asked = cut_lineage(weighted_questions(questions))
    docs = search.search_collections(_with_k(asked, 1, 0, settings), documents, settings=settings, embed=embed).join(asked.select("question_id", "document_weight"), "question_id").select(
        "question_id", F.lit("pdf").alias("type"), F.col("rank").cast("long").alias("item"), "content",
        F.concat(F.lit("PDF: "), "source").alias("source"), (F.col("score") * F.col("document_weight")).alias("score"),
    )

    terms = asked.select("question_id", qf.expanded_terms(qf.search_terms(F.col("text"))).alias("terms")).withColumn(
        "phrases", qf.phrases(F.col("terms"))
    )
    routed = None
    if routes is not None:
        routed = cut_lineage(asked.select("question_id", F.explode(qf.routed_tables(F.col("text"), routes)).alias("x")).select("question_id", F.col("x.name").alias("table")))
    found = small(tb.search_tables(terms, tables, routed, settings.table_hit_limit), settings)
    # texts are built for the rows that were found only
    rows = union_all(
        [
            table.rows.withColumn("__row_id", F.col(table.key).cast("string")).join(
                found.filter(F.col("table") == table.label).select("question_id", F.col("row_id").alias("__row_id"), F.col("score").alias("__score")), "__row_id"
            ).select("question_id", F.lit(table.label).alias("table"), F.col("__row_id").alias("row_id"), F.col("__score").alias("score"),
                     tb.record_text(table.rows.columns).alias("content"))
            for table in tables
        ]
    ).join(asked.select("question_id", "table_weight"), "question_id").select(
        "question_id", F.lit("database").alias("type"), F.xxhash64("table", "row_id").alias("item"), "content",
        F.concat(F.lit("DB: "), "table").alias("source"), (F.col("score") * F.col("table_weight")).alias("score"),
    )

    chat_hits = search.search_chats(_with_k(asked, 2, 6, settings), chats, chat_keywords, settings=settings, embed=embed)
    talk = chats.select("collection", "chunk_id", F.col("text").alias("content")).join(
        small(chat_hits, settings), ["collection", "chunk_id"]
    ).join(asked.select("question_id", "chat_weight"), "question_id").select(
        "question_id", F.lit("chat").alias("type"), F.col("rank").cast("long").alias("item"), "content",
        F.concat(F.lit("Chat: "), "source").alias("source"), (F.col("score") * F.col("chat_weight")).alias("score"),
    )
    more = []
    if links is not None:
        more.append(_fresh(asked, links, "document_weight", "public_link", "Link: ", 8, settings, embed))
    if connected is not None:
        more.append(_fresh(asked, connected, "table_weight", "external_db", "DB: ", 8, settings, embed))
    return union_all([docs, rows, talk, *more])


def hybrid_answers(
    questions: DataFrame, results: DataFrame, model: Callable[[str], str] | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """Merge the results, note evidence and conflicts, build the context, answer, check the answer and fall back.

    A weak first document without company is extracted directly.  An answer that
    refuses or is too short is replaced by the best result; a broken one by the
    answer that needs no model.
    """
    asked = cut_lineage(weighted_questions(questions))
    results = cut_lineage(results)
    ranked = cut_lineage(merge.people_first(
        merge.merged(results, asked.select("question_id", "is_aggregation", "is_explanation"), settings.merged_k),
        asked.select("question_id", qf.is_person_question(F.col("text")).alias("is_person")),
    ))
    terms = asked.select("question_id", qf.expanded_terms(qf.search_terms(F.col("text"))).alias("terms"))
    shown = merge.evidence(ranked, terms).groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "term", "type", "source"))).alias("evidence"))
    conflicts = merge.value_conflicts(ranked).groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("entity", "value", "wins", "n", "avg_confidence"))).alias("conflicts"))
    used = context.build(ranked, context.merged_block(), 8)
    best_hit = ranked.filter(F.col("rank") == 1).select(
        "question_id", F.col("type").alias("top_kind"), F.col("source").alias("top_source"), F.col("content").alias("top_content"))
    rows = asked
    for part in (used, shown, conflicts, context.breakdown(ranked), best_hit):
        rows = rows.join(part, "question_id", "left")
    rows = cut_lineage(rows.withColumn("has_conflicts", F.col("conflicts").isNotNull()))
    if model is None:
        made = rows.select("question_id", snippet(F.col("top_content"), F.col("text")).alias("answer"))
    else:
        only_tables = (F.coalesce("pdf", F.lit(0)) + F.coalesce("chat", F.lit(0)) + F.coalesce("public_link", F.lit(0))) == 0
        kind = answering.prompt_kind(F.col("is_aggregation"), F.col("is_comparison"), F.col("is_explanation"), only_tables)
        ready = rows.withColumn("prompt", answering.prompt(kind, F.col("context"), F.col("text"), F.col("has_conflicts")))
        made = answering.with_answers(ready.select("question_id", "prompt"), model).select("question_id", "answer")
    spare = merge.fallback_answers(
        asked.select("question_id", "text"),
        ranked.select(
            "question_id", "type", "item", "content", "source", "score", "rank", F.dense_rank().over(
                Window.partitionBy("question_id", "type").orderBy("source")).alias("table_place"),
            F.lit(None).cast("string").alias("page"), F.lit(None).cast("string").alias("platform"),
        ),
    ).withColumnRenamed("answer", "spare")
    direct = F.coalesce("direct", F.lit(False))
    answered = rows.join(made, "question_id", "left").join(spare, "question_id", "left").withColumn(
        "answer", F.when(direct, direct_answer(F.col("top_content"), F.col("top_source"), F.col("text"))).otherwise(
            checked_answer(F.col("answer"), F.col("top_kind"), F.col("top_source"), F.coalesce("top_confidence", F.lit(0.0)), F.col("top_content"), F.col("text"))))
    bad = F.col("top_content").isNotNull() & ~direct & degenerate(F.col("answer"))
    return answered.withColumn("answer", F.when(bad, F.col("spare")).otherwise(F.coalesce("answer", F.lit(answering.NO_DOCUMENTS)))).drop(
        "spare", "top_kind", "top_source", "top_content")
