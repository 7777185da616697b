"""Registered queries: merged results, evidence, conflicts, contexts and extractive answers.

The results of a question (one per part, see PART_QUESTIONS) are rows of the
given tables with a matching number: four documents, the orders of a customer,
the turns of a conversation, two web pages and the lines of an order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import lexicon
from corpusloom.functions import questions as qf
from corpusloom.operators import context, merge, tables as tb
from corpusloom.plans import sqltext as s
from corpusloom.plans.inputs import part_questions
from corpusloom.plans.question_queries import CLASS, KEYWORD_CLASS, TERMS, _intent, _weight
from corpusloom.plans.registry import Tables, query
from corpusloom.plans.text_queries import snippet_sql

RESULTS_SQL = """results AS MATERIALIZED (
  SELECT doc_id // 4 AS question_id, 'pdf' AS type, doc_id AS item, text AS content, 'PDF: ' || source AS source, round(1.0::DOUBLE / (1 + doc_id % 7), 4) AS score, (doc_id % 9)::VARCHAR AS page, NULL AS platform, 0 AS table_place FROM documents
  UNION ALL SELECT o_custkey, 'database', o_orderkey, 'o_orderkey: ' || o_orderkey || chr(10) || 'o_orderstatus: ' || o_orderstatus || chr(10) || 'Order Priority: ' || substr(o_orderpriority, 3, 1) || lower(substr(o_orderpriority, 4)), 'DB: orders ' || o_orderstatus, round(o_totalprice / 500000, 4), NULL, NULL, ascii(o_orderstatus) FROM orders
  UNION ALL SELECT conv_id, 'chat', turn, role || ' says no: ' || text, 'Chat: ' || role, round(1.0::DOUBLE / (1 + turn), 4), NULL, 'whatsapp', 0 FROM conversations
  UNION ALL SELECT page_id // 2, 'public_link', page_id, html, 'Public Link: ' || url, round(1.0::DOUBLE / (1 + page_id % 5), 4), NULL, NULL, 0 FROM pages
  UNION ALL SELECT l_orderkey, 'external_db', l_linenumber * 100000000 + l_partkey, 'l_partkey: ' || l_partkey || chr(10) || 'l_returnflag: ' || l_returnflag, 'DB: tpch / lineitem', round(l_discount * 10, 4), NULL, NULL, 0 FROM (SELECT l_orderkey, l_linenumber, l_partkey, max(l_returnflag) AS l_returnflag, max(l_discount) AS l_discount FROM lineitem GROUP BY ALL))"""


def results(t: Tables):
    lit = F.lit
    nothing = lit(None).cast("string")

    def frame(df, key, kind, item, content, source, score, page=nothing, platform=nothing, place=lit(0)):
        return df.select(
            key.cast("long").alias("question_id"), lit(kind).alias("type"), item.cast("long").alias("item"),
            content.alias("content"), source.alias("source"), F.round(score, 4).alias("score"),
            page.alias("page"), platform.alias("platform"), place.alias("table_place"),
        )

    c = F.col
    priority = F.concat(F.substring("o_orderpriority", 3, 1), F.lower(F.substring("o_orderpriority", 4, 100)))
    order_text = F.concat(
        lit("o_orderkey: "), c("o_orderkey").cast("string"), lit("\no_orderstatus: "), "o_orderstatus", lit("\nOrder Priority: "), priority
    )
    line_text = F.concat(lit("l_partkey: "), c("l_partkey").cast("string"), lit("\nl_returnflag: "), "l_returnflag")
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(
        F.max("l_returnflag").alias("l_returnflag"), F.max("l_discount").alias("l_discount")
    )
    return (
        frame(t.documents, F.floor(c("doc_id") / 4), "pdf", c("doc_id"), c("text"), F.concat(lit("PDF: "), "source"),
              1.0 / (1 + c("doc_id") % 7), page=(c("doc_id") % 9).cast("string"))
        .unionByName(frame(t.orders, c("o_custkey"), "database", c("o_orderkey"), order_text,
                           F.concat(lit("DB: orders "), "o_orderstatus"), c("o_totalprice") / 500000, place=F.ascii("o_orderstatus")))
        .unionByName(frame(t.conversations, c("conv_id"), "chat", c("turn"), F.concat("role", lit(" says no: "), "text"),
                           F.concat(lit("Chat: "), "role"), 1.0 / (1 + c("turn")), platform=lit("whatsapp")))
        .unionByName(frame(t.pages, F.floor(c("page_id") / 2), "public_link", c("page_id"), c("html"),
                           F.concat(lit("Public Link: "), "url"), 1.0 / (1 + c("page_id") % 5)))
        .unionByName(frame(lines, c("l_orderkey"), "external_db", c("l_linenumber") * 100_000_000 + c("l_partkey"), line_text,
                           lit("DB: tpch / lineitem"), c("l_discount") * 10))
    )


def intents(t: Tables):
    flags = qf.intent_flags(F.col("text"))
    return part_questions(t).select(
        "question_id", flags["is_aggregation"].alias("is_aggregation"), flags["is_explanation"].alias("is_explanation")
    )


def merged(t: Tables):
    return merge.merged(results(t), intents(t))


ORDER = "CASE type " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(lexicon.CONFIDENCE)) + " END"
FACTOR = "CASE type " + " ".join(f"WHEN '{n}' THEN {v}::DOUBLE" for n, v in lexicon.CONFIDENCE.items()) + " END"
MERGED_SQL = f"""WITH {s.PART_QUESTIONS}, {RESULTS_SQL},
intents AS (SELECT question_id, {_intent('aggregation')} AS agg, {_intent('explanation')} AS expl FROM questions),
conf0 AS (SELECT r.*, score * {FACTOR} * CASE WHEN agg THEN CASE WHEN type IN ('database', 'external_db') THEN 1.5 ELSE 1.0 END::DOUBLE
  WHEN expl THEN CASE WHEN type = 'pdf' THEN 1.5 ELSE 1.0 END::DOUBLE ELSE 1.0::DOUBLE END AS conf FROM results r JOIN intents USING (question_id)),
merged AS MATERIALIZED ({s.best('conf0', 'question_id', f'conf DESC, {ORDER}, score DESC, item', 20, cols='* EXCLUDE (conf), round(conf, 6) AS confidence')})"""


@query("r16_merged_results", MERGED_SQL + " SELECT question_id, type, item, source, score, confidence, rank, content FROM merged")
def merged_results(t: Tables):
    return merged(t).select("question_id", "type", "item", "source", "score", "confidence", "rank", "content")


SEARCH_TERMS_SQL = f"terms AS (SELECT question_id, {TERMS} AS terms FROM questions)"


def terms(t: Tables):
    return part_questions(t).select("question_id", qf.search_terms(F.col("text")).alias("terms"))


@query(
    "r17_combined_results",
    f"WITH {s.PART_QUESTIONS}, {RESULTS_SQL}, {SEARCH_TERMS_SQL} SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, type, item) AS rank FROM (SELECT question_id, type, item, source, round(CASE WHEN type = 'database' THEN "
    "len(list_filter(terms, lambda x: contains(lower(array_to_string(list_transform(string_split(content, chr(10)), lambda l: regexp_replace(l, '^[^:]*: ', '')), chr(10))), x))) / greatest(len(terms), 1) ELSE score END, 6)::DOUBLE AS score "
    "FROM results JOIN terms USING (question_id) WHERE type IN ('pdf', 'database', 'chat'))",
)
def combined_results(t: Tables):
    return merge.combined(results(t), terms(t)).select("question_id", "type", "item", "source", "score", "rank")


AGG_ROWS_SQL = (
    "aggs AS (SELECT question_id, 'COUNT' AS agg, 'orders' AS tab, '*' AS col, (SELECT count(*) FROM orders)::DOUBLE AS value FROM questions "
    "WHERE contains(lower(text), 'hitung'))"
)


@query(
    "r18_weighted_results",
    f"WITH {s.PART_QUESTIONS}, {RESULTS_SQL}, k AS (SELECT question_id, {KEYWORD_CLASS} AS kind FROM questions), "
    "w AS (SELECT question_id, " + ", ".join(
        f"{_weight('kind', lexicon.KEYWORD_WEIGHTS, i)} AS {n}" for i, n in enumerate(["tw", "dw", "cw"])
    ) + f" FROM k), {AGG_ROWS_SQL}, u AS (SELECT question_id, type, item, content, score * CASE type WHEN 'pdf' THEN dw WHEN 'chat' THEN cw ELSE tw END AS score "
    "FROM results JOIN w USING (question_id) WHERE type IN ('pdf', 'chat', 'database') UNION ALL "
    "SELECT question_id, 'database_aggregation', 0, agg || '(' || col || ') dari tabel ' || tab || ': ' || value::DECIMAL(38,2), tw FROM aggs JOIN w USING (question_id)) "
    + s.best("u", "question_id", "score DESC, type, item, content", 5, cols="question_id, type, item, content, rank, round(score, 6) AS score"),
)
def weighted_results(t: Tables):
    asked = part_questions(t)
    kind = asked.select("question_id", qf.keyword_class(F.col("text")).alias("kind"))
    weights = kind.select("question_id", *[c.alias(n) for n, c in qf.weights_of(F.col("kind"), lexicon.KEYWORD_WEIGHTS).items()])
    counted = tb.all_aggregates({"orders": t.orders}).filter(F.col("agg") == "COUNT")
    aggregates = asked.filter(F.lower("text").contains("hitung")).select("question_id", F.lit("orders").alias("table")).join(
        F.broadcast(counted), "table"
    )
    return merge.weighted(results(t), weights, aggregates, 5)


@query(
    "r19_exact_evidence",
    MERGED_SQL + f", {SEARCH_TERMS_SQL}, ev AS (SELECT question_id, m.rank AS result, m.type, m.source, lower(m.content) AS low, unnest(regexp_extract_all(lower(text), '{qf.TERM}')) AS term, "
    f"generate_subscripts(regexp_extract_all(lower(text), '{qf.TERM}'), 1) AS p FROM merged m JOIN questions USING (question_id) WHERE m.rank <= 5), "
    f"e2 AS (SELECT question_id, result, type, source, term, min(p) AS p FROM ev WHERE len(term) > 2 AND term NOT IN {s.in_list(lexicon.TERM_STOPWORDS)} AND contains(low, term) GROUP BY ALL) "
    + s.best("e2", "question_id", "result, p", 10, cols="question_id, rank, result, term, type, source"),
)
def exact_evidence(t: Tables):
    return merge.evidence(merged(t), terms(t))


@query(
    "q13_people_first",
    MERGED_SQL + f", pq AS (SELECT question_id, {s.any_of('lower(text)', lexicon.PERSON_QUESTION_WORDS)} AS person FROM questions), "
    "g AS (SELECT m.* EXCLUDE (rank), rank AS old_rank, CASE WHEN person THEN CASE WHEN type = 'chat' THEN 0 WHEN type IN ('database', 'external_db') THEN 1 ELSE 2 END ELSE 0 END AS grp FROM merged m JOIN pq USING (question_id)) "
    "SELECT question_id, type, item, old_rank, row_number() OVER (PARTITION BY question_id ORDER BY grp, old_rank) AS rank FROM g",
)
def people_first(t: Tables):
    person = part_questions(t).select("question_id", qf.is_person_question(F.col("text")).alias("is_person"))
    return merge.people_first(merged(t), person).select("question_id", "type", "item", "old_rank", "rank")


NUMBER = s.q(lexicon.NUMBER_PATTERN)
ROLE = s.q(lexicon.ROLE_PATTERN)
VALUES_SQL = f"""nums AS (SELECT question_id, rank, type, source, confidence, 'price_' || type AS entity, unnest(regexp_extract_all(content, {NUMBER}, 1)) AS value,
  generate_subscripts(regexp_extract_all(content, {NUMBER}, 1), 1) AS p FROM merged),
roles AS (SELECT question_id, rank, type, source, confidence, unnest(regexp_extract_all(content, {ROLE}, 1)) AS role, unnest(regexp_extract_all(content, {ROLE}, 2)) AS value,
  generate_subscripts(regexp_extract_all(content, {ROLE}, 1), 1) AS p FROM merged),
stated AS (SELECT * FROM nums UNION ALL SELECT question_id, rank, type, source, confidence, 'role_' || replace(lower(role), ' ', '_'), value, p FROM roles),
vals AS (SELECT question_id, entity, value, count(*) AS n, array_to_string(list_sort(list(DISTINCT source)), '|') AS sources, array_to_string(list_sort(list(DISTINCT type)), '|') AS types,
  round(avg(confidence), 8) AS avg_confidence, round(sum(confidence), 6) AS total, min(rank * 1000000 + p) AS first FROM stated GROUP BY ALL),
winners AS (SELECT question_id, entity, count(*) AS n_values, first(value ORDER BY total DESC, first) AS winner FROM vals GROUP BY ALL HAVING count(*) > 1)"""


@query(
    "r20_value_conflicts",
    MERGED_SQL + f", {VALUES_SQL} SELECT question_id, entity, value, n, sources, types, avg_confidence, n_values, value = winner AS wins FROM vals JOIN winners USING (question_id, entity)",
)
def value_conflicts(t: Tables):
    found = merge.value_conflicts(merged(t))
    return found.withColumn("sources", F.array_join("sources", "|")).withColumn("types", F.array_join("types", "|"))


def _contradictions_sql(test: str) -> str:
    return MERGED_SQL + f""", top4 AS (SELECT *, {test} AS neg FROM merged WHERE rank <= 4)
SELECT a.question_id, a.rank AS rank_a, a.type AS type_a, a.source AS source_a, a.confidence AS confidence_a, b.rank AS rank_b, b.type AS type_b, b.source AS source_b
FROM top4 a JOIN top4 b ON a.question_id = b.question_id AND a.rank < b.rank AND a.type <> b.type WHERE a.rank <= 3 AND a.neg AND NOT b.neg"""


@query("r21_contradictions", _contradictions_sql(r"regexp_matches(lower(content), '(^|[^\p{L}\p{N}_])(tidak|no)($|[^\p{L}\p{N}_])')"))
def contradictions(t: Tables):
    return merge.contradictions(merged(t))


@query("r21_contradictions_substring", _contradictions_sql("(contains(lower(content), 'tidak') OR contains(lower(content), 'no'))"))
def contradictions_substring(t: Tables):
    return merge.contradictions(merged(t), whole_words=False)


def _context_sql(body: str, limit: str, top: int) -> str:
    return MERGED_SQL + f""", b AS (SELECT m.*, {body} AS body, {limit} AS lim FROM merged m JOIN questions USING (question_id) WHERE rank <= {top})
SELECT question_id, string_agg('[Sumber ' || rank || ' — ' || source || ']:' || chr(10) || CASE WHEN len(body) > lim THEN left(body, lim) || '...' ELSE body END,
  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM b GROUP BY question_id"""


@query("r22_merged_context", _context_sql("content", "CASE WHEN type IN ('database', 'external_db') THEN 6000 ELSE 2000 END", 8))
def merged_context(t: Tables):
    return context.build(merged(t), context.merged_block(), 8)


@query("r22_small_context", _context_sql(snippet_sql("content", "text"), "150", 3))
def small_context(t: Tables):
    hits = merged(t).filter(F.col("rank") <= 3).join(part_questions(t), "question_id")
    return context.build(hits, context.merged_block(F.col("text")), 3)


@query(
    "r23_source_breakdown",
    MERGED_SQL + " SELECT question_id, " + ", ".join(f"sum((type = '{x}')::INT)::BIGINT AS {x}" for x in lexicon.CONFIDENCE)
    + ", max(CASE WHEN rank = 1 THEN confidence END) AS top_confidence, (max(CASE WHEN rank = 1 THEN confidence END) < 0.18 AND max(CASE WHEN rank = 1 THEN type END) = 'pdf' "
    "AND sum((type IN ('chat', 'database') AND rank <= 3)::INT) = 0) AS direct FROM merged WHERE rank <= 8 GROUP BY question_id",
)
def source_breakdown(t: Tables):
    return context.breakdown(merged(t))


@query(
    "t10_fallback_answer",
    f"""WITH {s.PART_QUESTIONS}, {RESULTS_SQL},
recs AS ({s.best("(SELECT * FROM results WHERE type = 'database')", 'question_id, table_place', 'item', 3, 'rn')}),
ft AS (SELECT question_id, table_place, first(source) AS source, string_agg('• ' || replace(content, chr(10), ', '), chr(10) ORDER BY rn) AS records FROM recs GROUP BY ALL),
tabs AS (SELECT question_id, first('Berdasarkan data dari tabel ' || source || ':' || chr(10) || chr(10) || records ORDER BY table_place) AS by_table FROM ft GROUP BY question_id),
kw AS (SELECT question_id, list_filter({s.split_words('lower(text)')}, lambda w: len(w) > 3) AS kws FROM questions),
fit AS (SELECT r.*, kws, round(score + 0.1::DOUBLE * len(list_filter(kws, lambda w: contains(lower(content), w))), 6) AS fit FROM results r JOIN kw USING (question_id) WHERE type = 'pdf'),
top AS (SELECT *, array_to_string(kws, ' ') AS kq FROM ({s.best('fit', 'question_id', 'fit DESC, item', 1, 'rn')})),
sn AS (SELECT *, {snippet_sql('content', 'kq')} AS sn FROM top),
docs AS (SELECT question_id, 'Berdasarkan ' || source || ' (halaman ' || coalesce(page, '?') || '):' || chr(10) || chr(10) || CASE WHEN sn = '' THEN content ELSE sn END AS by_doc FROM sn),
chats AS (SELECT question_id, first('Berdasarkan percakapan dari ' || source || ' (' || coalesce(platform, 'unknown') || '):' || chr(10) || chr(10) || content ORDER BY item) AS by_chat FROM results WHERE type = 'chat' GROUP BY question_id)
SELECT question_id, coalesce(CASE WHEN question_id % 2 = 0 THEN by_table END, by_doc, by_chat, 'Maaf, sistem tidak dapat menghasilkan jawaban yang valid. Silakan coba pertanyaan yang lebih spesifik.') AS answer
FROM questions LEFT JOIN tabs USING (question_id) LEFT JOIN docs USING (question_id) LEFT JOIN chats USING (question_id)""",
)
def fallback_answer(t: Tables):
    # tables answer only the even questions, so that the other branches show as well
    found = results(t).filter((F.col("type") != "database") | (F.col("question_id") % 2 == 0))
    return merge.fallback_answers(part_questions(t), found)
