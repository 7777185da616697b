"""Cleaning, truncation, snippets and checks of texts, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpusloom import lexicon
from corpusloom.functions.words import WORD_CHAR, WORD_END, WORD_START, any_of, let

SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+", " ")


def split_words(c: Column) -> Column:
    trimmed = strip(c)
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+"))


def clean_context(c: Column) -> Column:
    """Drop drawing characters, rules, runs of single letters, page and footnote marks, long capitals."""
    steps = [
        (f"{SPACE}+", " "),
        (f"[{lexicon.ARROW_CHARS}]", ""),
        (r"[\|│┃┆┊╎]", " "),
        (r"[-─━]{3,}", " "),
        (f"({WORD_START}{WORD_CHAR}{WORD_END}{SPACE}*){{4,}}", ""),
        (r"(?i)Page \d+ of \d+", ""),
        (r"\[\d+\]", ""),
        (f"{WORD_START}[A-Z]{{7,}}{WORD_END}", ""),
        (f"{SPACE}+", " "),
    ]
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return strip(c)


def clean_context_short(c: Column) -> Column:
    """Shorter chain without the steps for single letters, footnotes and capitals."""
    steps = [
        (f"[{lexicon.ARROW_CHARS}]", ""),
        (r"[\|│┃┆┊╎]", " "),
        (r"[-─━]{3,}", " "),
        (r"(?i)Page \d+ of \d+", ""),
        (f"{SPACE}+", " "),
    ]
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return strip(c)


def truncate_words(c: Column, n: int = 500) -> Column:
    cleaned = clean_context(c)
    parts = split_words(cleaned)
    return F.when(
        F.size(parts) > n, F.concat(F.array_join(F.slice(parts, 1, n), " "), F.lit("... [truncated]"))
    ).otherwise(cleaned)


def page_of(page: Column, c: Column) -> Column:
    """Known page, else the one of the first page mark in the text."""
    marked = F.nullif(F.regexp_extract(c, rf"\[PAGE{SPACE}+(\d+)\]", 1), F.lit(""))
    return F.when(page.isNull() | page.isin("?", "Unknown"), F.coalesce(marked, page)).otherwise(page)


def without_page_marks(c: Column) -> Column:
    return strip(F.regexp_replace(c, rf"\[PAGE{SPACE}+\d+\]", ""))


def first_words(c: Column, n: int = 15) -> Column:
    return F.array_join(F.slice(split_words(c), 1, n), " ")


def question_keywords(q: Column, longer_than: int = 2) -> Column:
    return F.filter(split_words(F.lower(q)), lambda w: F.length(w) > longer_than)


def keyword_hits(c: Column, keywords: Column) -> Column:
    """Number of keywords (with repetition) that the text contains."""
    return F.size(F.filter(keywords, lambda w: c.contains(w)))


def snippet(content: Column, question: Column, max_len: int = 3000) -> Column:
    """Part of the content that fits the question best."""
    parts = F.struct(
        question_keywords(question).alias("keywords"), F.split(content, r"\.").alias("sentences")
    )
    return let(parts, lambda v: _snippet(content, F.lower(question), v["keywords"], v["sentences"], max_len))


def _snippet(content: Column, asked: Column, keywords: Column, sentences: Column, max_len: int) -> Column:
    name = F.regexp_extract(content, f"{WORD_START}[A-Z][a-z]+(?:{SPACE}+[A-Z][a-z]+)*{WORD_END}", 0)
    by_name = let(
        name,
        lambda n: F.substring(strip(F.element_at(F.filter(sentences, lambda s: s.contains(n)), 1)), 1, 300),
    )

    lines = F.transform(
        F.split(content, "\n"),
        lambda line, i: F.struct(
            (-keyword_hits(F.lower(line), keywords)).alias("s"), i.alias("i"), line.alias("line")
        ),
    )
    by_line = let(
        F.filter(lines, lambda x: x["s"] < 0),
        lambda hit: F.when(
            F.size(hit) > 0,
            F.array_join(F.transform(F.slice(F.array_sort(hit), 1, 15), lambda x: x["line"]), "\n"),
        ),
    )

    def around(best: Column) -> Column:
        at = F.call_function("instr", content, best["text"])
        begin = F.greatest(F.lit(1), at - 300)
        end = F.least(F.length(content), at - 1 + F.length(best["text"]) + 1500)
        cut = strip(F.substring(content, begin, end - begin + 1))
        return F.when((best["s"] < 0) & (best["text"] != ""), shortened(cut, max_len))

    by_sentence = let(
        F.array_min(
            F.transform(
                sentences,
                lambda s, i: F.struct(
                    (-keyword_hits(F.lower(s), keywords)).alias("s"), i.alias("i"), strip(s).alias("text")
                ),
            )
        ),
        around,
    )
    return F.coalesce(
        F.when(any_of(asked, lexicon.PERSON_SNIPPET_WORDS) & (name != ""), by_name),
        F.when(content.contains("[") & content.contains("]"), by_line),
        by_sentence,
        shortened(content, max_len),
    )


def shortened(c: Column, max_len: int) -> Column:
    return F.when(F.length(c) > max_len, F.concat(F.substring(c, 1, max_len), F.lit("..."))).otherwise(c)


def direct_answer(content: Column, source: Column, question: Column) -> Column:
    """Phones or mail addresses when the question asks for them, else the snippet."""
    asked = F.lower(question)
    phones = F.array_distinct(
        F.regexp_extract_all(content, F.lit("(?i)" + lexicon.PHONE_PATTERN), F.lit(1))
    )
    mails = F.array_distinct(
        F.regexp_extract_all(content, F.lit(r"[\p{L}\p{N}_\.-]+@[\p{L}\p{N}_\.-]+"), F.lit(0))
    )
    lead = F.concat(F.lit("Berdasarkan "), source, F.lit(":\n\n"))
    return (
        F.when(
            any_of(asked, lexicon.PHONE_WORDS) & (F.size(phones) > 0),
            F.concat(lead, F.array_join(phones, ", "), F.lit("\n\nKontak lengkap:\n"), content),
        )
        .when(
            asked.contains("email") & (F.size(mails) > 0),
            F.concat(lead, F.lit("Email: "), F.array_join(mails, ", ")),
        )
        .otherwise(F.concat(lead, snippet(content, question)))
    )


def degenerate(c: Column) -> Column:
    """True for text that is too short, repetitive, unpronounceable or made of stock phrases."""
    return let(
        F.struct(F.lower(c).alias("low"), split_words(F.lower(c)).alias("parts")),
        lambda v: _degenerate(c, v["low"], v["parts"]),
    )


def _degenerate(c: Column, low: Column, parts: Column) -> Column:
    n = F.size(parts)
    # a word that makes up more than 30 % of n sorted words covers one of these positions
    step = F.greatest(F.lit(1), F.floor(n * 0.3).cast("int"))
    candidates = let(
        F.array_sort(parts),
        lambda ordered: F.array_distinct(
            F.transform(F.sequence(step, F.greatest(n, step), step), lambda i: F.get(ordered, i - 1))
        ),
    )
    top = F.array_max(F.transform(candidates, lambda w: F.size(F.filter(parts, lambda x: x == w))))
    clustered = F.size(F.filter(parts, lambda w: w.rlike(lexicon.CONSONANT_RUN)))
    yang = F.size(F.split(low, "yang")) - 1
    return (
        F.when(c.isNull() | (F.length(c) < 10), True)
        .when(any_of(low, lexicon.DEGENERATE_PHRASES), True)
        .when((n > 5) & let(top, lambda x: (x >= 5) & (x / n > 0.3)), True)
        .when((n > 0) & (clustered / n > 0.3), True)
        .when(n < 5, True)
        .otherwise(~any_of(low, lexicon.FIELD_MARKERS) & (yang >= 3))
    )


def percent(c: Column) -> Column:
    return F.concat(F.bround(c * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def formatted_result(kind: Column, source: Column, confidence: Column, content: Column, question: Column) -> Column:
    """One result as an answer."""
    return (
        F.when(
            kind == "database",
            F.concat(F.lit("Berdasarkan data dari "), source, F.lit(" (akurasi: "), percent(confidence), F.lit("):\n\n"), content),
        )
        .when(
            kind == "pdf",
            F.concat(
                F.lit("Informasi dari dokumen "), source, F.lit(" (relevansi: "), percent(confidence), F.lit("):\n\n"),
                F.coalesce(F.nullif(snippet(content, question), F.lit("")), content),
            ),
        )
        .otherwise(F.concat(F.lit("Dari "), source, F.lit(":\n\n"), content))
    )


def checked_answer(answer: Column, kind: Column, source: Column, confidence: Column, content: Column, question: Column) -> Column:
    """The answer, or the best result in its place when the answer refuses, echoes the prompt or is too short."""
    return (
        F.when(content.isNull(), answer)
        .when(any_of(F.lower(answer), lexicon.REFUSAL_PHRASES), formatted_result(kind, source, confidence, content, question))
        .when(
            F.size(split_words(answer)) < 5,
            F.concat(F.lit("Informasi dari "), source, F.lit(":\n"), content),
        )
        .otherwise(answer)
    )
