"""Benchmark decontamination with a positional inverted index of the training texts.

1. Count, over all texts, the terms that occur in the phrases.
2. Store the postings of the rarest term of every phrase: term, document,
   position and the terms around that position, as far as a phrase can reach.
   Each partition holds the postings of its own documents, sorted by term.
3. Shift each posting by the term's offset in the phrase and compare it with the
   terms stored around it: the second rarest term must stand at its offset, then
   all others (exact), or all terms must stand close together (proximity).  Only
   rarest terms have postings; no lists are intersected.

Nothing but matches leaves its partition.  Only built-in functions are used.  A
document is known by its id and a hash of its text, so repeated rows get the
same result and rows that share an id but not a text are kept apart.  Null texts
have no words; a null item id marks words as hit but is no counted item; an item
without words makes no phrase.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.llm.common import small, text_of, written

BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(word: Column) -> Column:
    """A-Z lower-cased, other letters as they are."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(
        F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def split_words(text: Column) -> Column:
    """Words as written, with an empty one where the text begins or ends with a break."""
    return F.split(text, BREAKS)


def word_count(words: Column) -> Column:
    n = F.size(words)
    first, last = F.element_at(words, 1) == "", F.element_at(words, -1) == ""
    return (n - first.cast("int") - (last & (n > 1)).cast("int")).cast("long")


def documents(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id, version (hash of the text) and words."""
    text = text_of(docs, text_column)
    return docs.select(docs[id_column].alias("doc"), F.xxhash64(text).alias("version"), split_words(text).alias("words"))


def tokens(rows: DataFrame) -> DataFrame:
    """doc, version, pos and term of every word."""
    return rows.select("doc", "version", F.posexplode("words").alias("pos", "word")).filter("word <> ''").select(
        "doc", "version", "pos", lowered(F.col("word")).alias("term"))


def phrases(items: DataFrame, id_column: str, text_column: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(item, phrase) and (phrase, terms): every window of an item, or the whole of a shorter one."""
    words = F.transform(F.filter(split_words(text_of(items, text_column)), lambda w: w != ""), lowered)
    rows = items.select(items[id_column].cast("string").alias("item"), words.alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - window + 1))
    rows = rows.select("item", "words", F.explode(starts).alias("at")).select("item", F.slice("words", F.col("at"), window).alias("terms"))
    made = written(rows.select("terms").distinct().withColumn("phrase", F.monotonically_increasing_id()))
    return rows.join(made, "terms").select("item", "phrase").distinct(), made


def ranked_terms(rows: DataFrame, made: DataFrame) -> DataFrame:
    """(phrase, offset, term, rank): the terms of each phrase from the rarest in all texts; phrases with an unseen term go."""
    listed = made.select("phrase", F.size("terms").alias("n"), F.posexplode("terms").alias("offset", "term"))
    vocabulary = written(listed.select("term").distinct())
    counts = written(tokens(rows).join(small(vocabulary), "term", "left_semi").groupBy("term").count())
    found = listed.join(counts, "term")
    order = Window.partitionBy("phrase").orderBy("count", "offset")
    found = found.withColumn("rank", F.row_number().over(order)).withColumn("seen", F.count("*").over(Window.partitionBy("phrase")))
    return written(found.filter("seen = n").select("phrase", "offset", "term", "rank"))


def postings(rows: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """The stored index: term, doc, version, pos, and the terms from position ``low`` on, up to ``reach`` on either side."""
    wanted = small(written(terms.select("term").distinct()))
    every = rows.select("doc", "version", "words", F.posexplode("words").alias("pos", "word")).filter("word <> ''").withColumn("term", lowered(F.col("word")))
    low = F.greatest(F.col("pos") - reach, F.lit(0))
    near = F.transform(F.slice("words", low + 1, F.col("pos") - low + reach + 1), lowered)
    kept = every.join(wanted, "term", "left_semi").select("term", "doc", "version", "pos", low.alias("low"), near.alias("near"))
    return written(kept.sortWithinPartitions("term", "doc", "pos"))


def exact_matches(rows: DataFrame, made: DataFrame, window: int = 10) -> DataFrame:
    """(doc, version, phrase, start, length) of every occurrence."""
    ranked = ranked_terms(rows, made)
    first, second = (ranked.filter(F.col("rank") == k).select("phrase", F.col("offset").alias(f"offset_{k}"), F.col("term").alias(f"term_{k}")) for k in (1, 2))
    asked = written(first.join(second, "phrase", "left").join(made, "phrase").withColumnRenamed("term_1", "term"))
    met = postings(rows, asked, window - 1).join(small(asked), "term").withColumn("start", F.col("pos") - F.col("offset_1"))
    at = F.greatest(F.col("start") - F.col("low") + 1, F.lit(1))
    met = met.filter((F.col("start") >= 0) & (F.col("term_2").isNull() | (F.try_element_at("near", at + F.col("offset_2")) == F.col("term_2"))))
    same = F.slice("near", at, F.size("terms")) == F.col("terms")
    return met.filter(same).select("doc", "version", "phrase", "start", F.size("terms").alias("length")).distinct()


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int, window: int = 10, id_column: str = "doc_id", text_column: str = "text",
                      item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc, version, phrase, terms): documents in which all terms of a phrase stand within ``slop`` words of its rarest one, in any order."""
    rows = documents(docs, id_column, text_column)
    _, made = phrases(items, item_column, item_text, window)
    asked = ranked_terms(rows, made).filter("rank = 1").select("phrase", "term").join(made, "phrase")
    met = postings(rows, asked, slop).join(small(written(asked)), "term")
    return met.filter(F.size(F.array_except("terms", "near")) == 0).select("doc", "version", "phrase", "terms").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_column: str = "doc_id", text_column: str = "text",
                  item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: doc, version, n_words, n_hit (words inside occurrences) and the items that occur, sorted as strings."""
    rows = documents(docs, id_column, text_column)
    owners, made = phrases(items, item_column, item_text, window)
    found = written(exact_matches(rows, made, window))
    key = ["doc", "version"]
    hit = found.select(*key, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos")).distinct().groupBy(*key).agg(F.count("*").alias("n_hit"))
    which = found.select(*key, "phrase").distinct().join(small(written(owners)), "phrase").select(*key, "item").distinct()
    which = which.groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items"))
    per = hit.withColumnsRenamed({"doc": "_doc", "version": "_version"})
    out = rows.select(*key, word_count(F.col("words")).alias("n_words"))
    out = out.join(per, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("version") == F.col("_version")), "left").drop("_doc", "_version")
    per = which.withColumnsRenamed({"doc": "_doc", "version": "_version"})
    out = out.join(per, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("version") == F.col("_version")), "left").drop("_doc", "_version")
    none = F.array().cast("array<string>")
    return out.select(*key, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))
