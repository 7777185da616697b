"""Registered queries of the operators in this package and, where SQL can express them, their SQL forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.llm import (
    decontam, exact_dedup, hard_negatives, jaccard_join, lang_crf, lexical_search, licenses, line_dedup, packing, quality, repeats, retrieval_packing,
    url_filter,
)
from corpusloom.llm.common import text_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_jaccard_join")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    out = jaccard_join.jaccard_components(table(spark, folder, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


@query("op1_links")
def op1_links(spark: SparkSession, folder: str) -> DataFrame:
    out = jaccard_join.jaccard_components(table(spark, folder, "documents"), count_links=True)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "n_links")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents),
b AS (
  SELECT item_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM benchmark),
p AS (
  SELECT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM p),
s AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
hits AS (
  SELECT s.doc_id, s.i, lens.n, p.item_id FROM s JOIN lens ON s.i + lens.n - 1 <= len(s.w)
  JOIN p ON p.n = lens.n AND p.phrase = array_to_string(s.w[s.i:s.i + lens.n - 1], ' ')),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS q FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query("op2_decontamination", OP2_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    out = decontam.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return out.select(
        F.col("doc").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


@query("op8_exact_dedup", OP8_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = exact_dedup.exact_groups(docs, carry={"text_sha256": F.sha2(text_of(docs), 256)})
    return out.withColumnRenamed("id", "doc_id")


@query("op10_url_filter")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    out = url_filter.judged(table(spark, folder, "pages"))
    return out.select("page.page_id", "host", "path", "rule", "verdict", "score")


@query("op10_whole_urls")
def op10_whole(spark: SparkSession, folder: str) -> DataFrame:
    out = url_filter.judged(table(spark, folder, "pages"), whole=True)
    return out.select("page.page_id", "host", "path", "rule", "verdict", "score")


@query("op5_repeats")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.kept_texts(repeats.repeated_bytes(table(spark, folder, "documents")))


@query("op4_packing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"))


@query("op3_line_dedup")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.without_similar_lines(table(spark, folder, "documents"))
    return out.select(
        "doc_id", F.size(F.split(text_of(out), "\n")).cast("long").alias("n_lines"), F.size("removed_lines").cast("long").alias("n_removed"),
        F.array_join("removed_lines", ",").alias("removed_lines"), F.sha2(text_of(out, "kept_text"), 256).alias("kept_sha256"))


@query("op9_quality")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    out = quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return out.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op7_language_id")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return lang_crf.languages(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query("op6_licenses")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    out = licenses.licenses(table(spark, folder, "documents"))
    lines = F.array_distinct(F.transform("found", lambda x: x["line"]))
    families = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"])))
    return out.select(
        F.col("id").alias("doc_id"), "n_paragraphs", F.size(lines).cast("long").alias("n_licensed"), F.array_join(families, ",").alias("families"),
        F.array_join(lines, ",").alias("lines"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents),
b AS (
  SELECT item_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(w) AS term FROM b) GROUP BY ALL),
total AS (SELECT count(*) AS nd, sum(len(w))::BIGINT AS nt FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, total GROUP BY term, nd),
part AS (SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nt))) AS score FROM tf JOIN df USING (term), total),
s AS (SELECT item_id, doc_id, sum(times * score)::BIGINT AS score FROM part JOIN q USING (term) GROUP BY item_id, doc_id HAVING sum(times * score) > 0)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s) WHERE rank <= 20
"""


@query("op12_lexical_search", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    out = lexical_search.ranked_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return out.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id, list_inner_product(a.e, v.e)::BIGINT AS score
  FROM v a, v WHERE a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score) WHERE rank <= 5
"""


@query("op13_hard_negatives", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.hard_negatives(hard_negatives.with_relabelled(table(spark, folder, "embeddings")))


@query("op11_retrieval_packing")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval_packing.packed_with_neighbours(table(spark, folder, "documents"))
