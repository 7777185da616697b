"""Registered queries: question analysis over one question per part."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import lexicon
from corpusloom.functions import questions as qf
from corpusloom.functions.words import let, stem, words
from corpusloom.operators import patterns
from corpusloom.plans import sqltext as s
from corpusloom.plans.inputs import part_questions
from corpusloom.plans.registry import Tables, query



def Q():
    return F.col("text")


WITH = f"WITH {s.PART_QUESTIONS} "


def _intent(name: str) -> str:
    return s.matches_any("lower(text)", lexicon.INTENT_PATTERNS[name])


PRIMARY = "CASE " + " ".join(f"WHEN {_intent(n)} THEN '{n}'" for n in lexicon.INTENT_PRIORITY) + " ELSE 'unknown' END"
CLASS = (
    f"CASE WHEN {_intent('aggregation')} THEN 'aggregation' WHEN {_intent('explanation')} THEN 'explanation' "
    f"WHEN {_intent('data_retrieval')} THEN 'data_retrieval' ELSE 'other' END"
)
KEYWORD_CLASS = (
    f"CASE WHEN {s.any_of('lower(text)', lexicon.KEYWORD_AGGREGATION)} THEN 'aggregation' "
    f"WHEN {s.any_of('lower(text)', lexicon.KEYWORD_EXPLANATION)} THEN 'explanation' "
    f"WHEN {s.any_of('lower(text)', lexicon.KEYWORD_CHAT)} THEN 'chat' ELSE 'other' END"
)


def _weight(c: str, table, i: int) -> str:
    return "CASE " + " ".join(f"WHEN {c} = '{k}' THEN {v[i]}::DOUBLE" for k, v in table.items()) + " END"


@query(
    "q1_intent",
    WITH + "SELECT question_id, " + ", ".join(f"{_intent(n)} AS is_{n}" for n in lexicon.INTENT_PATTERNS)
    + f", {PRIMARY} AS primary_intent FROM questions",
)
def intent(t: Tables):
    flags = [c.alias(n) for n, c in qf.intent_flags(Q()).items()]
    return part_questions(t).select("question_id", *flags, qf.primary_intent(Q()).alias("primary_intent"))


@query(
    "q2_keyword_intent",
    WITH + f", c AS (SELECT question_id, {KEYWORD_CLASS} AS kind FROM questions) SELECT question_id, kind, "
    + ", ".join(
        f"{_weight('kind', lexicon.KEYWORD_WEIGHTS, i)} AS {n}"
        for i, n in enumerate(["table_weight", "document_weight", "chat_weight"])
    )
    + " FROM c",
)
def keyword_intent(t: Tables):
    df = part_questions(t).select("question_id", qf.keyword_class(Q()).alias("kind"))
    return df.select("*", *[c.alias(n) for n, c in qf.weights_of(F.col("kind"), lexicon.KEYWORD_WEIGHTS).items()])


@query(
    "q3_source_weights",
    WITH + f", c AS (SELECT question_id, {CLASS} AS kind FROM questions), w AS (SELECT question_id, kind, "
    + ", ".join(
        f"{_weight('kind', lexicon.INTENT_WEIGHTS, i)} AS {n}"
        for i, n in enumerate(["table_weight", "document_weight", "chat_weight"])
    )
    + " FROM c) SELECT *, floor(5 * document_weight)::INT AS document_k, greatest(floor(5 * chat_weight)::INT, 6) AS chat_k, "
    "greatest(floor(5 * document_weight)::INT, 8) AS link_k, greatest(floor(5 * table_weight)::INT, 8) AS connected_k FROM w",
)
def source_weights(t: Tables):
    df = part_questions(t).select("question_id", qf.weight_class(Q()).alias("kind"))
    df = df.select("*", *[c.alias(n) for n, c in qf.weights_of(F.col("kind"), lexicon.INTENT_WEIGHTS).items()])
    return df.select(
        "*",
        qf.weighted_k(F.col("document_weight"), 5).alias("document_k"),
        qf.weighted_k(F.col("chat_weight"), 5, 6).alias("chat_k"),
        qf.weighted_k(F.col("document_weight"), 5, 8).alias("link_k"),
        qf.weighted_k(F.col("table_weight"), 5, 8).alias("connected_k"),
    )


@query(
    "q4_search_route",
    WITH + f", f AS (SELECT question_id, {s.any_of('lower(text)', lexicon.ROUTE_TABLE_WORDS)} AS a, "
    f"{s.any_of('lower(text)', lexicon.ROUTE_DOCUMENT_WORDS)} AS b FROM questions) "
    "SELECT question_id, CASE WHEN a = b THEN 'hybrid' WHEN a THEN 'structured' ELSE 'unstructured' END AS route FROM f",
)
def search_route(t: Tables):
    return part_questions(t).select("question_id", qf.search_route(Q()).alias("route"))


def _table_scores() -> str:
    parts = []
    for i, (name, keys) in enumerate(lexicon.ROUTE_TABLES.items()):
        extra = f" + CASE WHEN {s.any_of('lower(text)', lexicon.PERSON_WORDS)} THEN 2 ELSE 0 END" if name == lexicon.PERSON_TABLE else ""
        parts.append(f"SELECT question_id, '{name}' AS target, {i} AS i, {s.hits_of('lower(text)', keys)}{extra} AS score FROM questions")
    return " UNION ALL ".join(parts)


@query(
    "q5_table_routing",
    WITH + f", sc AS ({_table_scores()}), m AS (SELECT *, max(score) OVER (PARTITION BY question_id) AS top FROM sc) "
    "SELECT question_id, target, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, i) AS rank "
    "FROM m WHERE score > 0 OR top = 0",
)
def table_routing(t: Tables):
    df = part_questions(t).select("question_id", F.posexplode(qf.routed_tables(Q())).alias("i", "x"))
    return df.select(
        "question_id", F.col("x.name").alias("target"), (-F.col("x.neg")).alias("score"), (F.col("i") + 1).alias("rank")
    )


TERMS = (
    f"list_distinct(list_filter(regexp_extract_all(lower(text), '{qf.TERM}'), "
    f"lambda w: len(w) > 2 AND w NOT IN {s.in_list(lexicon.TERM_STOPWORDS)}))"
)


@query("q6_search_terms", WITH + f"SELECT question_id, unnest({TERMS}) AS term FROM questions")
def search_terms(t: Tables):
    return part_questions(t).select("question_id", F.explode(qf.search_terms(Q())).alias("term"))


@query(
    "q6_entities",
    WITH + "SELECT question_id, "
    + ", ".join(
        f"array_to_string(list_transform(regexp_extract_all(text, {s.q('(?i)' + p)}, {1 if '(' in p else 0}), lambda v: coalesce(v, '')), '|') AS {n}"
        for n, p in lexicon.ENTITY_PATTERNS.items()
    )
    + ", array_to_string(list_concat("
    + ", ".join(f"CASE WHEN contains(lower(text), '{k}') THEN ['{v}'] ELSE [] END" for k, v in lexicon.FIELD_WORDS.items())
    + "), '|') AS field_references FROM questions",
)
def question_entities(t: Tables):
    return part_questions(t).select(
        "question_id",
        *[F.array_join(c, "|").alias(n) for n, c in qf.entities(Q()).items()],
        F.array_join(qf.field_references(Q()), "|").alias("field_references"),
    )


def _variants(groups, keep_case: bool, take=None) -> str:
    parts = []
    for term, ws in groups.items():
        ws = ws[:take]
        made = [f"replace(lower(text), '{term}', '{w}')" for w in ws]
        if keep_case:
            made += [f"replace(text, '{term}', '{w}')" for w in ws]
        parts.append(f"CASE WHEN contains(lower(text), '{term}') THEN [{', '.join(made)}] ELSE [] END")
    return ", ".join(parts)


@query(
    "q7_expanded_documents",
    WITH + f"SELECT DISTINCT question_id, unnest(list_concat([text, lower(text)], {_variants(lexicon.DOCUMENT_SYNONYMS, True)})) AS query FROM questions",
)
def expanded_documents(t: Tables):
    return part_questions(t).select("question_id", F.explode(qf.expanded(Q())).alias("query"))


@query(
    "q7_expanded_tables",
    WITH + f"SELECT DISTINCT question_id, unnest(list_concat([text, lower(text)], {_variants(lexicon.TABLE_SYNONYMS, False)})) AS query FROM questions",
)
def expanded_tables(t: Tables):
    return part_questions(t).select(
        "question_id", F.explode(qf.expanded(Q(), lexicon.TABLE_SYNONYMS, keep_case=False)).alias("query")
    )


@query(
    "q7_expanded_chat",
    WITH + f", e AS (SELECT question_id, list_concat([text], {_variants(lexicon.CHAT_SYNONYMS, False, 2)}) AS l FROM questions), "
    "u AS (SELECT question_id, unnest(l) AS query, generate_subscripts(l, 1) AS i FROM e), "
    "d AS (SELECT question_id, query, min(i) AS i FROM u GROUP BY ALL), "
    "r AS (SELECT question_id, query, row_number() OVER (PARTITION BY question_id ORDER BY i) AS place FROM d) "
    "SELECT * FROM r WHERE place <= 3",
)
def expanded_chat(t: Tables):
    df = part_questions(t).select("question_id", F.posexplode(qf.expanded_for_chat(Q())).alias("i", "query"))
    return df.select("question_id", "query", (F.col("i") + 1).alias("place"))


@query(
    "q7_appended",
    WITH + "SELECT question_id, text"
    + "".join(
        f" || CASE WHEN contains(lower(text), '{k}') THEN ' {' '.join(v)}' ELSE '' END"
        for k, v in lexicon.APPEND_SYNONYMS.items()
    )
    + " AS query FROM questions",
)
def appended(t: Tables):
    return part_questions(t).select("question_id", qf.appended(Q()).alias("query"))


def _expanded_terms() -> str:
    groups = ", ".join(
        f"CASE WHEN contains(term, '{k}') OR term IN {s.in_list(v)} THEN [{', '.join(s.q(x) for x in [k, *v])}] ELSE [] END"
        for k, v in lexicon.TABLE_SYNONYMS.items()
    )
    stemmed = s.stem("term", lexicon.STEM_SUFFIXES, lexicon.STEM_PREFIXES)
    return f"list_concat([term], {groups}, CASE WHEN term IN {s.in_list(lexicon.BRANDS)} THEN [] ELSE [{stemmed}] END)"


@query(
    "q8_expanded_terms",
    WITH + f", tm AS (SELECT question_id, unnest({TERMS}) AS term FROM questions) "
    f"SELECT DISTINCT question_id, unnest({_expanded_terms()}) AS term FROM tm",
)
def expanded_terms(t: Tables):
    return part_questions(t).select("question_id", F.explode(qf.expanded_terms(qf.search_terms(Q()))).alias("term"))


@query(
    "q9_stems",
    f"WITH w AS (SELECT DISTINCT unnest({s.words('text')}) AS word FROM documents) SELECT word, "
    f"{s.stem('word', lexicon.STEM_SUFFIXES, lexicon.STEM_PREFIXES)} AS stem, "
    f"{s.stem('word', lexicon.STEM_SUFFIXES_TABLE, lexicon.STEM_PREFIXES)} AS table_stem FROM w",
)
def stems(t: Tables):
    found = t.documents.select(F.explode(F.array_distinct(words(F.col("text")))).alias("word")).distinct()
    return found.select(
        "word", stem(F.col("word")).alias("stem"),
        stem(F.col("word"), lexicon.STEM_SUFFIXES_TABLE).alias("table_stem"),
    )


def _phrases() -> str:
    return ", ".join(
        f"CASE WHEN list_contains(terms, '{a}') AND list_contains(terms, '{b}') THEN ['{a} {b}'] ELSE [] END"
        for a, b in lexicon.PHRASES
    )


@query(
    "q10_phrases",
    WITH + f", tm AS (SELECT question_id, {TERMS} AS terms FROM questions), ph AS (SELECT question_id, terms, list_concat({_phrases()}) AS p FROM tm), "
    "o AS (SELECT question_id, array_to_string(p, '|') AS phrases, list_sort(list_filter(terms, "
    "lambda x: NOT list_contains(string_split(array_to_string(p, ' '), ' '), x))) AS rest FROM ph) "
    "SELECT question_id, phrases, array_to_string(rest, '|') AS remaining FROM o",
)
def phrases(t: Tables):
    both = let(qf.search_terms(Q()), lambda terms: F.struct(qf.phrases(terms).alias("found"), qf.without_phrases(terms).alias("rest")))
    return part_questions(t).select(
        "question_id",
        F.explode(F.array(both)).alias("x"),  # the terms are found once
    ).select("question_id", F.array_join("x.found", "|").alias("phrases"), F.array_join(F.array_sort("x.rest"), "|").alias("remaining"))


@query(
    "q11_file_reference",
    WITH + "SELECT question_id, coalesce("
    + ", ".join(
        f"nullif(regexp_extract(lower(text), {s.q(p.replace('[' + chr(92) + 'w_-]', '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_-]'))}, 1), '')"
        for p in lexicon.FILE_PATTERNS
    )
    + ") AS file FROM questions",
)
def file_reference(t: Tables):
    return part_questions(t).select("question_id", qf.file_reference(Q()).alias("file"))


@query("q13_person_question", WITH + f"SELECT question_id, {s.any_of('lower(text)', lexicon.PERSON_QUESTION_WORDS)} AS is_person FROM questions")
def person_question(t: Tables):
    return part_questions(t).select("question_id", qf.is_person_question(Q()).alias("is_person"))


@query(
    "q5_dictionary_hits",
    "WITH p AS (SELECT DISTINCT lower(w) AS name FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM benchmark) WHERE length(w) >= 6) "
    "SELECT doc_id, count(*) AS n_names, max(length(name)) AS longest, min(name) AS first_name FROM documents JOIN p ON contains(lower(text), name) GROUP BY doc_id",
)
def dictionary_hits(t: Tables):
    """All long words of the benchmark as one dictionary, looked up in all documents."""
    names = t.benchmark.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w")).filter(F.length("w") >= 6).select(F.lower("w").alias("name"))
    met = patterns.entries_within(t.documents, ["doc_id"], F.lower("text"), names)
    return met.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_names"), F.max(F.length("name").cast("long")).alias("longest"), F.min("name").alias("first_name"))
