"""Question analysis as column expressions over a frame of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom import lexicon
from corpusloom.functions.words import any_of, hits_of, let, matches_any, stem

TERM = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_+]*[\p{L}\p{N}_])?"


def strings(*items) -> Column:
    return F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<string>")


def intent_flags(q: Column) -> dict[str, Column]:
    low = F.lower(q)
    return {f"is_{name}": matches_any(low, pats) for name, pats in lexicon.INTENT_PATTERNS.items()}


def primary_intent(q: Column) -> Column:
    flags = intent_flags(q)
    return F.coalesce(
        *[F.when(flags[f"is_{n}"], F.lit(n)) for n in lexicon.INTENT_PRIORITY], F.lit("unknown")
    )


def weight_class(q: Column) -> Column:
    flags = intent_flags(q)
    return (
        F.when(flags["is_aggregation"], "aggregation")
        .when(flags["is_explanation"], "explanation")
        .when(flags["is_data_retrieval"], "data_retrieval")
        .otherwise("other")
    )


def keyword_class(q: Column) -> Column:
    low = F.lower(q)
    return (
        F.when(any_of(low, lexicon.KEYWORD_AGGREGATION), "aggregation")
        .when(any_of(low, lexicon.KEYWORD_EXPLANATION), "explanation")
        .when(any_of(low, lexicon.KEYWORD_CHAT), "chat")
        .otherwise("other")
    )


def weights_of(kind: Column, table: dict[str, tuple[float, float, float]]) -> dict[str, Column]:
    """Table, document and chat weight of a class."""
    out = {}
    for i, name in enumerate(["table_weight", "document_weight", "chat_weight"]):
        col = F
        for key, values in table.items():
            col = col.when(kind == key, F.lit(float(values[i])))
        out[name] = col
    return out


def weighted_k(weight: Column, k: int, least: int = 0) -> Column:
    return F.greatest(F.floor(weight * k).cast("int"), F.lit(least))


def search_route(q: Column, table_words=None, document_words=None) -> Column:
    low = F.lower(q)
    table = any_of(low, table_words or lexicon.ROUTE_TABLE_WORDS)
    document = any_of(low, document_words or lexicon.ROUTE_DOCUMENT_WORDS)
    return F.when(table == document, "hybrid").when(table, "structured").otherwise("unstructured")


def routed_tables(q: Column, routes: dict[str, list[str]] | None = None, person_table: str = lexicon.PERSON_TABLE) -> Column:
    """array<struct<place, neg, name>>: tables by falling score; all of them when none scores."""
    low = F.lower(q)
    items = []
    for i, (name, keys) in enumerate((routes or lexicon.ROUTE_TABLES).items()):
        score = hits_of(low, keys)
        if name == person_table:
            score = score + F.when(any_of(low, lexicon.PERSON_WORDS), 2).otherwise(0)
        items.append(F.struct((-score).alias("neg"), F.lit(i).alias("i"), F.lit(name).alias("name")))
    every = F.array_sort(F.array(*items))
    scored = F.filter(every, lambda x: x["neg"] < 0)
    return F.when(F.size(scored) > 0, scored).otherwise(every)


def search_terms(q: Column) -> Column:
    found = F.regexp_extract_all(F.lower(q), F.lit(TERM), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(*lexicon.TERM_STOPWORDS)))


def entities(q: Column) -> dict[str, Column]:
    """Matches per entity kind; where a pattern has a group, the group is the value."""
    return {
        name: F.regexp_extract_all(q, F.lit("(?iU)" + pattern), F.lit(1 if "(" in pattern else 0))
        for name, pattern in lexicon.ENTITY_PATTERNS.items()
    }


def field_references(q: Column) -> Column:
    low = F.lower(q)
    return F.flatten(
        F.array(*[F.when(low.contains(k), strings(v)).otherwise(strings()) for k, v in lexicon.FIELD_WORDS.items()])
    )


def expanded(q: Column, synonyms=None, keep_case: bool = True) -> Column:
    """The question, its lower-case form and one variant per synonym of every term it contains."""
    low = F.lower(q)
    variants = [F.array(q, low)]
    for term, words in (synonyms or lexicon.DOCUMENT_SYNONYMS).items():
        made = [F.replace(low, F.lit(term), F.lit(w)) for w in words]
        if keep_case:
            made += [F.replace(q, F.lit(term), F.lit(w)) for w in words]
        variants.append(F.when(low.contains(term), F.array(*made)).otherwise(strings()))
    return F.array_distinct(F.flatten(F.array(*variants)))


def expanded_for_chat(q: Column) -> Column:
    low = F.lower(q)
    variants = [F.array(q)]
    for term, words in lexicon.CHAT_SYNONYMS.items():
        made = F.array(*[F.replace(low, F.lit(term), F.lit(w)) for w in words[:2]])
        variants.append(F.when(low.contains(term), made).otherwise(strings()))
    return F.slice(F.array_distinct(F.flatten(F.array(*variants))), 1, 3)


def appended(q: Column) -> Column:
    low = F.lower(q)
    parts = [q]
    for term, words in lexicon.APPEND_SYNONYMS.items():
        parts.append(F.when(low.contains(term), F.lit(" " + " ".join(words))).otherwise(""))
    return F.concat(*parts)


def expanded_terms(terms: Column, synonyms=None) -> Column:
    """Search terms with the synonym groups they touch and, unless a brand, their stems."""
    groups = synonyms or lexicon.TABLE_SYNONYMS

    def of(term):
        low = F.lower(term)
        parts = [F.array(term)]
        for key, words in groups.items():
            parts.append(
                F.when(low.contains(key) | low.isin(*words), strings(key, *words)).otherwise(strings())
            )
        parts.append(F.when(low.isin(*lexicon.BRANDS), strings()).otherwise(F.array(stem(low))))
        return F.flatten(F.array(*parts))

    return F.array_distinct(F.flatten(F.transform(terms, of)))


def phrases(terms: Column) -> Column:
    def within(low: Column) -> Column:
        return F.flatten(
            F.array(
                *[
                    F.when(F.array_contains(low, a) & F.array_contains(low, b), strings(f"{a} {b}")).otherwise(strings())
                    for a, b in lexicon.PHRASES
                ]
            )
        )

    return let(F.transform(terms, lambda t: F.lower(t)), within)


def without_phrases(terms: Column) -> Column:
    def rest(t: Column) -> Column:
        used = F.flatten(F.transform(phrases(t), lambda p: F.split(p, " ")))
        return let(used, lambda u: F.filter(t, lambda x: ~F.array_contains(u, F.lower(x))))

    return let(terms, rest)


def file_reference(q: Column) -> Column:
    low = F.lower(q)
    found = [
        F.nullif(F.regexp_extract(low, p.replace(r"[\w_-]", r"[\p{L}\p{N}_-]"), 1), F.lit(""))
        for p in lexicon.FILE_PATTERNS
    ]
    return F.coalesce(*found)


def is_person_question(q: Column) -> Column:
    return any_of(F.lower(q), lexicon.PERSON_QUESTION_WORDS)


def aggregate_kind(q: Column) -> Column:
    low = F.lower(q)
    return F.coalesce(*[F.when(any_of(low, words), F.lit(name)) for name, words in lexicon.AGGREGATE_WORDS.items()])


def resolved_aggregates(questions: DataFrame, schemas: dict[str, list[str]]) -> DataFrame:
    """(question_id, agg, table, column) per mentioned table.

    ``schemas`` lists the numeric columns of each table in their order; a table
    is mentioned by its name or by the name without its plural ending.  The
    column is the first one named, else the first usual measure, else the first.
    """
    low = F.lower(F.col("text"))
    picks = []
    for table, columns in schemas.items():
        if not columns:
            continue
        mentioned = low.contains(table.lower()) | low.contains(table.rstrip("s").lower())
        named = [
            F.when(low.contains(c.lower()) | low.contains(c.replace("_", " ").lower()), F.lit(c)) for c in columns
        ]
        usual = [c for c in columns if any(m in c.lower() for m in lexicon.MEASURE_WORDS)]
        column = F.coalesce(*named, F.lit((usual or columns)[0]))
        picks.append(F.when(mentioned, F.struct(F.lit(table).alias("table"), column.alias("column"))))
    return (
        questions.select(
            "question_id", aggregate_kind(F.col("text")).alias("agg"),
            F.explode(F.filter(F.array(*picks), lambda x: x.isNotNull())).alias("pick"),
        )
        .filter(F.col("agg").isNotNull())
        .select(
            "question_id", "agg", F.col("pick.table").alias("table"),
            F.when(F.col("agg") == "COUNT", F.lit("*")).otherwise(F.col("pick.column")).alias("column"),
        )
    )
