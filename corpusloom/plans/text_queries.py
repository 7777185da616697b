"""Registered queries: cleaning, truncation, snippets, checks and splitting of whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import lexicon
from corpusloom.functions import text as tf
from corpusloom.plans import sqltext as s
from corpusloom.plans.inputs import document_chunks
from corpusloom.plans.registry import Tables, query



def X():
    return F.col("text")


LETTER = r"[\p{L}\p{N}_]"


def clean_sql(c: str) -> str:
    """SQL form of the cleaning chain; words of two and more letters are fenced to emulate word edges."""
    g = "'g'"
    x = f"regexp_replace({c}, '{s.SP}+', ' ', {g})"
    x = f"regexp_replace({x}, '[{lexicon.ARROW_CHARS}]', '', {g})"
    x = f"regexp_replace({x}, '[|│┃┆┊╎]', ' ', {g})"
    x = f"regexp_replace({x}, '[-─━]{{3,}}', ' ', {g})"
    x = f"regexp_replace({x}, '({LETTER}{{2,}})', chr(1) || '\\1' || chr(2), {g})"
    x = f"regexp_replace({x}, '(^|[^\\p{{L}}\\p{{N}}_\\x01])((?:{LETTER}{s.SP}*){{4,}})', '\\1', {g})"
    x = f"regexp_replace({x}, '[\\x01\\x02]', '', {g})"
    x = f"regexp_replace({x}, '(?i)Page \\d+ of \\d+', '', {g})"
    x = f"regexp_replace({x}, '\\[\\d+\\]', '', {g})"
    x = f"regexp_replace({x}, '({LETTER}+)', chr(1) || '\\1' || chr(2), {g})"
    x = f"regexp_replace({x}, '\\x01[A-Z]{{7,}}\\x02', '', {g})"
    x = f"regexp_replace({x}, '[\\x01\\x02]', '', {g})"
    x = f"regexp_replace({x}, '{s.SP}+', ' ', {g})"
    return s.strip(x)


@query("t2_clean_context", f"SELECT doc_id, {clean_sql('text')} AS cleaned FROM documents")
def clean_context(t: Tables):
    return t.documents.select("doc_id", tf.clean_context(X()).alias("cleaned"))


@query("t2_clean_pages", f"SELECT page_id, {clean_sql('html')} AS cleaned FROM pages")
def clean_pages(t: Tables):
    return t.pages.select("page_id", tf.clean_context(F.col("html")).alias("cleaned"))


def short_sql(c: str) -> str:
    x = f"regexp_replace({c}, '[{lexicon.ARROW_CHARS}]', '', 'g')"
    x = f"regexp_replace({x}, '[|│┃┆┊╎]', ' ', 'g')"
    x = f"regexp_replace({x}, '[-─━]{{3,}}', ' ', 'g')"
    x = f"regexp_replace({x}, '(?i)Page \\d+ of \\d+', '', 'g')"
    return s.strip(f"regexp_replace({x}, '{s.SP}+', ' ', 'g')")


@query("t2_clean_short", f"SELECT doc_id, {short_sql('text')} AS cleaned FROM documents")
def clean_short(t: Tables):
    return t.documents.select("doc_id", tf.clean_context_short(X()).alias("cleaned"))


@query(
    "t3_truncate_words",
    f"WITH c AS (SELECT doc_id, {clean_sql('text')} AS x FROM documents), w AS (SELECT doc_id, x, {s.split_words('x')} AS ws FROM c) "
    "SELECT doc_id, CASE WHEN len(ws) > 150 THEN array_to_string(ws[1:150], ' ') || '... [truncated]' ELSE x END AS cut FROM w",
)
def truncate_words(t: Tables):
    return t.documents.select("doc_id", tf.truncate_words(X(), 150).alias("cut"))


@query(
    "t4_page_marker",
    "WITH m AS (SELECT doc_id, CASE WHEN lang = 'en' THEN NULL WHEN lang = 'fr' THEN '?' ELSE source END AS page, "
    "'[PAGE ' || n_chars || '] ' || text || ' [PAGE 7]' AS x FROM documents), "
    f"k AS (SELECT doc_id, page, x, {s.strip(f'''regexp_replace(x, '{chr(92)}[PAGE{s.SP}+{chr(92)}d+{chr(92)}]', '', 'g')''')} AS body FROM m) "
    f"SELECT doc_id, body, CASE WHEN page IS NULL OR page IN ('?', 'Unknown') THEN coalesce(nullif(regexp_extract(x, '\\[PAGE{s.SP}+(\\d+)\\]', 1), ''), page) ELSE page END AS page "
    "FROM k WHERE len(body) >= 10",
)
def page_marker(t: Tables):
    marked = t.documents.select(
        "doc_id",
        F.when(F.col("lang") == "en", None).when(F.col("lang") == "fr", "?").otherwise(F.col("source")).alias("page"),
        F.concat(F.lit("[PAGE "), F.col("n_chars").cast("string"), F.lit("] "), X(), F.lit(" [PAGE 7]")).alias("text"),
    )
    return marked.select(
        "doc_id", tf.without_page_marks(X()).alias("body"), tf.page_of(F.col("page"), X()).alias("page")
    ).filter(F.length("body") >= 10)


@query(
    "t5_citation_fields",
    f"WITH w AS (SELECT *, {s.split_words('text')} AS ws, TRY_CAST(CASE WHEN lang = 'en' THEN n_chars::VARCHAR ELSE source END AS INT) AS page FROM documents) "
    "SELECT doc_id, page, CASE WHEN page IS NULL THEN source ELSE source || ' (Halaman ' || page || ')' END AS shown_name, "
    "'/files/' || lang || '/' || source || CASE WHEN page IS NULL THEN '' ELSE '#page=' || page END AS page_url, "
    "left(text, 300) AS preview, array_to_string(ws[1:15], ' ') AS search_text, left(text, 200) AS chat_preview FROM w",
)
def citation_fields(t: Tables):
    page = F.when(F.col("lang") == "en", F.col("n_chars").cast("string")).otherwise(F.col("source"))
    return t.documents.withColumn("page", page.try_cast("int")).select(
        "doc_id", "page",
        F.when(F.col("page").isNull(), F.col("source"))
        .otherwise(F.concat("source", F.lit(" (Halaman "), F.col("page").cast("string"), F.lit(")"))).alias("shown_name"),
        F.concat(
            F.lit("/files/"), "lang", F.lit("/"), "source",
            F.coalesce(F.concat(F.lit("#page="), F.col("page").cast("string")), F.lit("")),
        ).alias("page_url"),
        F.substring("text", 1, 300).alias("preview"),
        tf.first_words(X(), 15).alias("search_text"),
        F.substring("text", 1, 200).alias("chat_preview"),
    )


def snippet_sql(content: str, question: str) -> str:
    kws = f"list_filter({s.split_words(f'lower({question})')}, lambda w: len(w) > 2)"

    def hits(expr: str) -> str:
        return f"len(list_filter({kws}, lambda k: contains(lower({expr}), k)))"

    edge = r"[^\p{L}\p{N}_]"
    name = f"regexp_extract({content}, '(?:^|{edge})([A-Z][a-z]+(?:{s.SP}+[A-Z][a-z]+)*)(?:$|{edge})', 1)"
    sentences = f"string_split({content}, '.')"
    by_name = f"left({s.strip(f'list_filter({sentences}, lambda y: contains(y, {name}))[1]')}, 300)"
    lines = f"list_filter(list_transform(string_split({content}, chr(10)), lambda l, i: {{'s': -{hits('l')}, 'i': i, 'l': l}}), lambda y: y.s < 0)"
    by_line = f"array_to_string(list_transform(list_sort({lines})[1:15], lambda y: y.l), chr(10))"
    best = f"list_sort(list_transform({sentences}, lambda y, i: {{'s': -{hits('y')}, 'i': i, 't': {s.strip('y')}}}))[1]"
    at = f"instr({content}, ({best}).t)"
    begin = f"greatest(1, {at} - 300)"
    end = f"least(len({content}), {at} - 1 + len(({best}).t) + 1500)"
    around = s.strip(f"substr({content}, {begin}, {end} - {begin} + 1)")
    cut = f"CASE WHEN len({around}) > 3000 THEN left({around}, 3000) || '...' ELSE {around} END"
    head = f"CASE WHEN len({content}) > 3000 THEN left({content}, 3000) || '...' ELSE {content} END"
    return (
        f"CASE WHEN {s.any_of(f'lower({question})', lexicon.PERSON_SNIPPET_WORDS)} AND {name} <> '' THEN {by_name} "
        f"WHEN contains({content}, '[') AND contains({content}, ']') AND len({lines}) > 0 THEN {by_line} "
        f"WHEN ({best}).s < 0 AND ({best}).t <> '' THEN {cut} ELSE {head} END"
    )


# a person question for french texts, chat lines for german ones, the first words of the text elsewhere
SNIPPET_INPUT = (
    "inp AS (SELECT doc_id, CASE WHEN lang = 'de' THEN '[' || source || ']' || chr(10) || text ELSE text END AS content, "
    "CASE WHEN lang = 'fr' THEN 'siapa handle ' || source ELSE 'apa ' || source || ' the les der que und' END AS question FROM documents)"
)


def _snippet_input(t: Tables):
    return t.documents.select(
        "doc_id",
        F.when(F.col("lang") == "de", F.concat(F.lit("["), "source", F.lit("]\n"), X())).otherwise(X()).alias("content"),
        F.when(F.col("lang") == "fr", F.concat(F.lit("siapa handle "), "source"))
        .otherwise(F.concat(F.lit("apa "), "source", F.lit(" the les der que und"))).alias("question"),
    )


@query("t6_snippet", f"WITH {SNIPPET_INPUT} SELECT doc_id, {snippet_sql('content', 'question')} AS snippet FROM inp")
def snippet(t: Tables):
    return _snippet_input(t).select("doc_id", tf.snippet(F.col("content"), F.col("question")).alias("snippet"))


DIRECT_INPUT = (
    "inp AS (SELECT doc_id, text AS content, source, CASE lang WHEN 'en' THEN 'nomor telepon ' || source WHEN 'fr' THEN 'email ' || source "
    "ELSE 'apa ' || source || ' der que' END AS question FROM documents)"
)


@query(
    "t7_direct_answer",
    f"""WITH {DIRECT_INPUT}, f AS (SELECT *, list_distinct(regexp_extract_all(content, {s.q('(?i)' + lexicon.PHONE_PATTERN)}, 1)) AS ph,
    regexp_extract_all(content, {s.q('(?i)' + lexicon.PHONE_PATTERN)}, 1) AS ph_all,
    regexp_extract_all(content, '[\\p{{L}}\\p{{N}}_.-]+@[\\p{{L}}\\p{{N}}_.-]+', 0) AS ml FROM inp),
    o AS (SELECT *, list_filter(ph_all, lambda v, i: list_position(ph_all, v) = i) AS p1, list_filter(ml, lambda v, i: list_position(ml, v) = i) AS m1 FROM f)
    SELECT doc_id, CASE WHEN {s.any_of('lower(question)', lexicon.PHONE_WORDS)} AND len(p1) > 0
      THEN 'Berdasarkan ' || source || ':' || chr(10) || chr(10) || array_to_string(p1, ', ') || chr(10) || chr(10) || 'Kontak lengkap:' || chr(10) || content
    WHEN contains(lower(question), 'email') AND len(m1) > 0 THEN 'Berdasarkan ' || source || ':' || chr(10) || chr(10) || 'Email: ' || array_to_string(m1, ', ')
    ELSE 'Berdasarkan ' || source || ':' || chr(10) || chr(10) || {snippet_sql('content', 'question')} END AS answer FROM o""",
)
def direct_answer(t: Tables):
    lang = F.col("lang")
    question = (
        F.when(lang == "en", F.concat(F.lit("nomor telepon "), "source"))
        .when(lang == "fr", F.concat(F.lit("email "), "source"))
        .otherwise(F.concat(F.lit("apa "), "source", F.lit(" der que")))
    )
    return t.documents.select("doc_id", tf.direct_answer(X(), F.col("source"), question).alias("answer"))


def degenerate_sql(c: str) -> str:
    low = f"lower({c})"
    ws = s.split_words(low)
    top = f"list_max(map_values(list_histogram({ws})))"
    return (
        f"CASE WHEN {c} IS NULL OR len({c}) < 10 THEN true WHEN {s.any_of(low, lexicon.DEGENERATE_PHRASES)} THEN true "
        f"WHEN len({ws}) > 5 AND {top} >= 5 AND {top} / len({ws}) > 0.3 THEN true "
        f"WHEN len({ws}) > 0 AND len(list_filter({ws}, lambda w: regexp_matches(w, '{lexicon.CONSONANT_RUN}'))) / len({ws}) > 0.3 THEN true "
        f"WHEN len({ws}) < 5 THEN true ELSE NOT {s.any_of(low, lexicon.FIELD_MARKERS)} "
        f"AND (len({low}) - len(replace({low}, 'yang', ''))) / 4 >= 3 END"
    )


@query("t8_degenerate", f"SELECT doc_id, {degenerate_sql('text')} AS degenerate FROM documents")
def degenerate(t: Tables):
    return t.documents.select("doc_id", tf.degenerate(X()).alias("degenerate"))


CHECK_INPUT = (
    "inp AS (SELECT doc_id, CASE lang WHEN 'fr' THEN 'Maaf, tidak tahu' WHEN 'de' THEN 'ja' WHEN 'es' THEN 'context: ' || source ELSE text END AS answer, "
    "CASE source WHEN 'src1' THEN 'database' WHEN 'src2' THEN 'chat' WHEN 'src3' THEN NULL ELSE 'pdf' END AS kind, "
    "source, round(n_chars % 1000 / 1000.0, 3)::DOUBLE AS confidence, CASE WHEN source <> 'src3' THEN text END AS content, 'apa les der que' AS question FROM documents)"
)


@query(
    "t9_checked_answer",
    f"""WITH {CHECK_INPUT}, p AS (SELECT *, round_even(confidence * 100, 0)::BIGINT || '%' AS pc FROM inp)
    SELECT doc_id, CASE WHEN content IS NULL THEN answer WHEN {s.any_of('lower(answer)', lexicon.REFUSAL_PHRASES)} THEN
      CASE kind WHEN 'database' THEN 'Berdasarkan data dari ' || source || ' (akurasi: ' || pc || '):' || chr(10) || chr(10) || content
      WHEN 'pdf' THEN 'Informasi dari dokumen ' || source || ' (relevansi: ' || pc || '):' || chr(10) || chr(10) || coalesce(nullif({snippet_sql('content', 'question')}, ''), content)
      ELSE 'Dari ' || source || ':' || chr(10) || chr(10) || content END
    WHEN len({s.split_words('answer')}) < 5 THEN 'Informasi dari ' || source || ':' || chr(10) || content ELSE answer END AS answer FROM p""",
)
def checked_answer(t: Tables):
    lang, source = F.col("lang"), F.col("source")
    answer = (
        F.when(lang == "fr", "Maaf, tidak tahu").when(lang == "de", "ja")
        .when(lang == "es", F.concat(F.lit("context: "), source)).otherwise(X())
    )
    kind = F.when(source == "src1", "database").when(source == "src2", "chat").when(source == "src3", None).otherwise("pdf")
    content = F.when(source != "src3", X())
    confidence = F.round(F.col("n_chars") % 1000 / 1000.0, 3)
    return t.documents.select(
        "doc_id",
        tf.checked_answer(answer, kind, source, confidence, content, F.lit("apa les der que")).alias("answer"),
    )
