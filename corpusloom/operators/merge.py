"""Merging results of several source types, evidence, conflicts and extractive answers.

Results are (question_id, type, item, content, source, score): ``item`` numbers
the results of one type in their own order.  Everything after the first cut
works on the few best results of a question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom import lexicon
from corpusloom.functions.text import question_keywords, snippet
from corpusloom.functions.words import let
from corpusloom.operators.sizing import best, small
from corpusloom.settings import DEFAULTS

TYPES = list(lexicon.CONFIDENCE)


def by_type(kind: Column, values: dict[str, float]) -> Column:
    col = F
    for name, value in values.items():
        col = col.when(kind == name, F.lit(value))
    return col


def type_order(kind: Column) -> Column:
    return by_type(kind, {n: i for i, n in enumerate(TYPES)})


def merged(results: DataFrame, intents: DataFrame, k: int = DEFAULTS.merged_k) -> DataFrame:
    """Confidence by type and intent, k best per question.  intents (question_id, is_aggregation, is_explanation).

    Factor and boost are the same for all results of one type, so each type is
    cut to its k best before the join; a question with very many results never
    meets in one task.
    """
    kind = F.col("type")
    first = best(results, ["question_id", "type"], [F.desc("score"), F.asc("item")], k).drop("rank")
    boost = (
        F.when(F.col("is_aggregation"), F.when(kind.isin(*lexicon.TABLE_TYPES), lexicon.INTENT_BOOST).otherwise(1.0))
        .when(F.col("is_explanation"), F.when(kind == "pdf", lexicon.INTENT_BOOST).otherwise(1.0))
        .otherwise(1.0)
    )
    scored = first.join(small(intents), "question_id").withColumn(
        "confidence", F.col("score") * by_type(kind, lexicon.CONFIDENCE) * boost
    )
    order = [F.desc("confidence"), F.asc(type_order(kind)), F.desc("score"), F.asc("item")]
    top = best(scored, ["question_id"], order, k).drop("is_aggregation", "is_explanation")
    return top.withColumn("confidence", F.round("confidence", 6))


def combined(results: DataFrame, terms: DataFrame) -> DataFrame:
    """Older merge: table records score the share of search terms in their values.  terms (question_id, terms).

    Records read ``name: value`` per line; the names are no hits.  Ranked by score.
    """
    values = F.lower(F.regexp_replace("content", r"(?m)^[^:\n]*: ", ""))
    share = F.size(F.filter("terms", lambda t: values.contains(F.lower(t)))) / F.greatest(F.size("terms"), F.lit(1))
    scored = results.filter(F.col("type").isin("pdf", "database", "chat")).join(small(terms), "question_id").withColumn(
        "score", F.round(F.when(F.col("type") == "database", share).otherwise(F.col("score")), 6)
    )
    along = Window.partitionBy("question_id").orderBy(F.desc("score"), F.asc("type"), F.asc("item"), F.asc("content"))
    return scored.withColumn("rank", F.row_number().over(along)).drop("terms")


def weighted(results: DataFrame, weights: DataFrame, aggregates: DataFrame, k: int = 5) -> DataFrame:
    """Scores times source weight, together with aggregate rows at full table weight, k best.

    weights (question_id, table_weight, document_weight, chat_weight);
    aggregates (question_id, agg, table, column, value).
    """
    kind = F.col("type")
    weight = F.when(kind == "pdf", F.col("document_weight")).when(kind == "chat", F.col("chat_weight")).otherwise(F.col("table_weight"))
    first = best(
        results.filter(kind.isin("pdf", "chat", "database")), ["question_id", "type"],
        [F.desc("score"), F.asc("item"), F.asc("content")], k,
    )
    rows = first.join(small(weights), "question_id").select(
        "question_id", "type", "item", "content", (F.col("score") * weight).alias("score")
    )
    direct = aggregates.join(weights, "question_id").select(
        "question_id", F.lit("database_aggregation").alias("type"),
        F.lit(0).cast("long").alias("item"),
        F.concat("agg", F.lit("("), "column", F.lit(") dari tabel "), "table", F.lit(": "), F.round("value", 2).cast("decimal(38,2)").cast("string")).alias("content"),
        F.col("table_weight").alias("score"),
    )
    both = rows.unionByName(direct)
    top = best(both, ["question_id"], [F.desc("score"), F.asc("type"), F.asc("item"), F.asc("content")], k)
    return top.withColumn("score", F.round("score", 6))


def evidence(results: DataFrame, terms: DataFrame, first: int = 5, keep: int = 10) -> DataFrame:
    """Search terms that occur in the first results, in order of result and term, first ones kept."""
    low = F.lower("content")
    found = (
        results.filter(F.col("rank") <= first)
        .join(terms, "question_id")
        .select("question_id", "rank", "type", "source", low.alias("low"), F.posexplode("terms").alias("p", "term"))
        .filter(F.col("low").contains(F.lower("term")))
        .withColumnRenamed("rank", "result")
    )
    return best(found, ["question_id"], [F.asc("result"), F.asc("p")], keep).select(
        "question_id", "rank", "result", "term", "type", "source"
    )


def people_first(results: DataFrame, questions: DataFrame) -> DataFrame:
    """For person questions chat comes first, then tables, then the rest; nothing is cut.  questions (question_id, is_person)."""
    kind = F.col("type")
    group = F.when(kind == "chat", 0).when(kind.isin(*lexicon.TABLE_TYPES), 1).otherwise(2)
    joined = results.join(questions, "question_id").withColumnRenamed("rank", "old_rank")
    place = F.when(F.col("is_person"), group).otherwise(0)
    along = Window.partitionBy("question_id").orderBy(place, F.asc("old_rank"))
    return joined.withColumn("rank", F.row_number().over(along)).drop("is_person")


# conflicts ----------------------------------------------------------------------------------------


def stated_values(results: DataFrame) -> DataFrame:
    """(question_id, entity, value, ...) for numbers by type and for ``Role: Name`` pairs, found in one pass over the results."""
    keys = ["question_id", "rank", "type", "source", "confidence"]
    pattern = F.lit(lexicon.ROLE_PATTERN)
    found = results.select(
        *keys, F.regexp_extract_all("content", F.lit(lexicon.NUMBER_PATTERN), F.lit(1)).alias("numbers"),
        F.regexp_extract_all("content", pattern, F.lit(1)).alias("roles"), F.regexp_extract_all("content", pattern, F.lit(2)).alias("names"))
    # posexplode_outer, since a plain one makes Spark find the values once more to test their number
    each = found.select(*keys, "roles", F.size("numbers").alias("n"), F.posexplode_outer(F.concat("numbers", "names")).alias("i", "value"))
    number, at = F.col("i") < F.col("n"), F.col("i") - F.col("n")
    role = F.concat(F.lit("role_"), F.replace(F.lower(F.get("roles", at)), F.lit(" "), F.lit("_")))
    return each.filter(F.col("i").isNotNull()).select(
        *keys, F.when(number, F.concat(F.lit("price_"), "type")).otherwise(role).alias("entity"),
        F.when(number, F.col("i")).otherwise(at).alias("p"), "value")


def value_conflicts(results: DataFrame) -> DataFrame:
    """Entities with more than one value: every value with its sources, mean confidence and whether it wins."""
    values = stated_values(results).groupBy("question_id", "entity", "value").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.array_sort(F.collect_set("type")).alias("types"),
        F.round(F.avg("confidence"), 8).alias("avg_confidence"),
        F.round(F.sum("confidence"), 6).alias("total"),
        F.min(F.struct("rank", "p")).alias("first"),
    ).filter(F.col("question_id").isNotNull() & F.col("entity").isNotNull())
    # the values of an entity come from the few results of a question, so a window holds them and nothing is read twice
    own = Window.partitionBy("question_id", "entity")
    winner = F.min_by("value", F.struct((-F.col("total")).alias("t"), "first")).over(own)
    return values.withColumn("n_values", F.count(F.lit(1)).over(own)).withColumn("winner", winner).filter(F.col("n_values") > 1).select(
        "question_id", "entity", "value", "n", "sources", "types", "avg_confidence", "n_values",
        (F.col("value") == F.col("winner")).alias("wins"),
    )


def contradictions(results: DataFrame, whole_words: bool = True) -> DataFrame:
    """Pairs among the first four results, of different types, where only the better one negates."""
    low = F.lower("content")
    negates = (
        low.rlike(r"(?<![\p{L}\p{N}_])(tidak|no)(?![\p{L}\p{N}_])") if whole_words else low.contains("tidak") | low.contains("no")
    )
    top = results.filter(F.col("rank") <= 4).select("question_id", "rank", "type", "source", "confidence", negates.alias("negates"))
    a = top.filter((F.col("rank") <= 3) & F.col("negates")).select(
        "question_id", F.col("rank").alias("rank_a"), F.col("type").alias("type_a"),
        F.col("source").alias("source_a"), F.col("confidence").alias("confidence_a"),
    )
    b = top.filter(~F.col("negates")).select(
        "question_id", F.col("rank").alias("rank_b"), F.col("type").alias("type_b"), F.col("source").alias("source_b")
    )
    return a.join(b, "question_id").filter((F.col("rank_a") < F.col("rank_b")) & (F.col("type_a") != F.col("type_b")))


# extractive answers -------------------------------------------------------------------------------


def fallback_answers(questions: DataFrame, results: DataFrame) -> DataFrame:
    """Answer without a model: records of the first table, else the best document, else the first chat.

    results also carry ``table_place`` (order of the table), ``page`` and ``platform``.
    """
    records = best(
        results.filter(F.col("type") == "database"), ["question_id", "table_place"], [F.asc("item")], 3
    )
    first_table = records.groupBy("question_id", "table_place").agg(
        F.first("source").alias("source"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: F.concat(F.lit("• "), F.replace(x["content"], F.lit("\n"), F.lit(", ")))),
            "\n",
        ).alias("records"),
    )
    tables = first_table.groupBy("question_id").agg(
        F.min_by(F.concat(F.lit("Berdasarkan data dari tabel "), "source", F.lit(":\n\n"), "records"), "table_place").alias("by_table")
    )
    asked = questions.select("question_id", question_keywords(F.col("text"), 3).alias("keywords"))
    low = F.lower("content")
    documents = (
        results.filter(F.col("type") == "pdf")
        .join(small(asked), "question_id")
        .withColumn("fit", F.round(F.col("score") + 0.1 * F.size(F.filter("keywords", lambda w: low.contains(w))), 6))
    )
    top = best(documents, ["question_id"], [F.desc("fit"), F.asc("item")], 1)
    by_document = let(
        snippet(F.col("content"), F.array_join("keywords", " ")),
        lambda s: F.concat(
            F.lit("Berdasarkan "), F.col("source"), F.lit(" (halaman "), F.coalesce(F.col("page"), F.lit("?")), F.lit("):\n\n"),
            F.when(s == "", F.col("content")).otherwise(s),
        ),
    )
    docs = top.select("question_id", by_document.alias("by_document"))
    chats = results.filter(F.col("type") == "chat").groupBy("question_id").agg(
        F.min_by(
            F.concat(F.lit("Berdasarkan percakapan dari "), "source", F.lit(" ("), F.coalesce("platform", F.lit("unknown")), F.lit("):\n\n"), "content"),
            "item",
        ).alias("by_chat")
    )
    return (
        questions.select("question_id")
        .join(tables, "question_id", "left").join(docs, "question_id", "left").join(chats, "question_id", "left")
        .select(
            "question_id",
            F.coalesce(
                "by_table", "by_document", "by_chat",
                F.lit("Maaf, sistem tidak dapat menghasilkan jawaban yang valid. Silakan coba pertanyaan yang lebih spesifik."),
            ).alias("answer"),
        )
    )
