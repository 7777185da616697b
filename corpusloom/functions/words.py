"""Word level column functions.  A word is a run of letters, digits and underscores in any script."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpusloom import lexicon

WORD_CHAR = r"[\p{L}\p{N}_]"
WORD = WORD_CHAR + "+"
WORD_START = r"(?<![\p{L}\p{N}_])"
WORD_END = r"(?![\p{L}\p{N}_])"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def any_of(c: Column, needles) -> Column:
    """True when the text contains one of the literal needles."""
    test = F.lit(False)
    for needle in needles:
        test = test | c.contains(needle)
    return test


def hits_of(c: Column, needles) -> Column:
    """How many of the literal needles the text contains."""
    total = F.lit(0)
    for needle in needles:
        total = total + c.contains(needle).cast("int")
    return total


def matches_any(c: Column, patterns) -> Column:
    return c.rlike("|".join(f"(?:{p})" for p in patterns))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def eval_tokens(c: Column) -> Column:
    """Tokens used by the answer metrics: longer than two characters and no stopword."""
    return F.filter(
        words(c), lambda t: (F.length(t) > 2) & ~t.isin(*lexicon.METRIC_STOPWORDS)
    )


def space_words(c: Column) -> Column:
    """Whitespace separated words; no words for blank text."""
    trimmed = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s+"))


def stem(c: Column, suffixes=None, prefixes=None) -> Column:
    """Strip the first matching suffix, then the first matching prefix, keeping three characters or more."""
    suffixes = suffixes or lexicon.STEM_SUFFIXES
    prefixes = prefixes or lexicon.STEM_PREFIXES

    def cut_tail(base: Column) -> Column:
        cut = F
        for s in suffixes:
            fits = base.endswith(s) & (F.length(base) > len(s) + 2)
            cut = cut.when(fits, F.substring(base, F.lit(1), F.length(base) - len(s)))
        return cut.otherwise(base)

    def cut_head(base: Column) -> Column:
        cut = F
        for p in prefixes:
            fits = base.startswith(p) & (F.length(base) > len(p) + 2)
            cut = cut.when(fits, F.substring(base, F.lit(len(p) + 1), F.length(base)))
        return cut.otherwise(base)

    return let(let(F.trim(F.lower(c)), cut_tail), cut_head)
