"""Registered queries: whole plans from questions to answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import dense
from corpusloom.operators.sizing import cut_lineage
from corpusloom.plans import ask, sqltext as s
from corpusloom.plans.inputs import benchmark_questions, document_chunks
from corpusloom.plans.metric_queries import DENSE_HITS
from corpusloom.plans.registry import Tables, query
from corpusloom.plans.search_queries import _chat_inputs
from corpusloom.plans.table_queries import asked, searchables
from corpusloom.plans.text_queries import snippet_sql


@query(
    "x3_extractive_answers",
    f"WITH {s.DOCS}, {s.ASKED}, {s.lexical()}, {s.distances()}, {DENSE_HITS}, "
    "ctx AS (SELECT question_id, string_agg('[Source ' || rank || ' — ' || source || ' (txt)]:' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM dense_hits GROUP BY question_id) "
    f"SELECT q.question_id, q.text, context, {snippet_sql('content', 'q.text')} AS answer FROM questions q JOIN ctx USING (question_id) JOIN dense_hits h ON h.question_id = q.question_id AND h.rank = 1",
)
def extractive_answers(t: Tables):
    chunks = document_chunks(t).withColumn("doc_type", F.lit("txt"))
    return ask.ask(benchmark_questions(t), chunks)


@query("hybrid_answers")
def hybrid_answers(t: Tables):
    """Documents, tables and chats searched for one question per supplier."""
    _, chats, keywords = _chat_inputs(t)
    chats, keywords, questions = cut_lineage(chats), cut_lineage(keywords), cut_lineage(asked(t))
    found = ask.hybrid_results(questions, document_chunks(t, by_language=True), searchables(t), chats, keywords)
    return ask.hybrid_answers(questions, found)


@query(
    "e5_hit_metrics",
    """WITH qs AS (SELECT vec_id AS question_id, embedding::DOUBLE[] AS e FROM embeddings), dist AS (SELECT q.question_id, v.vec_id AS chunk_id, v.label,
      round(greatest(list_inner_product(q.e, q.e) + list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]) - 2 * list_inner_product(q.e, v.embedding::DOUBLE[]), 0), 9) AS distance FROM qs q, embeddings v),
    r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, chunk_id) AS rank, round(1 / (1 + distance), 4) AS score FROM dist QUALIFY rank <= 8)
    SELECT question_id, sum((score >= 0.5)::INT) / 8 AS precision_at_k, round(coalesce(1 / min(CASE WHEN score >= 0.5 THEN rank END), 0), 7) AS mrr,
      round(count(DISTINCT label) / count(*), 7) AS context_coverage, round(avg(score), 7) AS avg_chunk_score FROM r GROUP BY question_id""",
)
def hit_metrics(t: Tables):
    from corpusloom.operators import metrics

    questions = t.embeddings.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vec"))
    vectors = t.embeddings.select(F.lit("all").alias("collection"), F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    hits = dense.retrieve(questions, vectors, 8).join(
        t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("source")), "chunk_id"
    )
    return metrics.hit_metrics(hits, 8, F.col("score") >= 0.5, 7)


PAIRS_SQL = """pairs AS (SELECT a.conv_id, a.turn, a.text AS hyp, b.text AS ref FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"""


def _token_sql() -> str:
    from corpusloom.plans.metric_queries import etok

    return f"""WITH RECURSIVE {PAIRS_SQL}, tk AS MATERIALIZED (SELECT conv_id, turn, {etok('hyp')} AS a, {etok('ref')} AS r FROM pairs),
h AS MATERIALIZED (SELECT conv_id, turn, unnest(a) AS tok, generate_subscripts(a, 1) AS i FROM tk), f AS MATERIALIZED (SELECT conv_id, turn, unnest(r) AS tok, generate_subscripts(r, 1) AS j FROM tk),
clip AS (SELECT conv_id, turn, sum(least(x.n, y.n)) AS clipped FROM (SELECT conv_id, turn, tok, count(*) AS n FROM h GROUP BY ALL) x JOIN (SELECT conv_id, turn, tok, count(*) AS n FROM f GROUP BY ALL) y USING (conv_id, turn, tok) GROUP BY ALL),
lcs AS (SELECT 0 AS i, conv_id, turn, j, tok, 0 AS v FROM f UNION ALL SELECT i, conv_id, turn, j, tok, max(c) OVER (PARTITION BY conv_id, turn ORDER BY j) AS v FROM (
  SELECT l.i + 1 AS i, l.conv_id, l.turn, l.j, l.tok, CASE WHEN l.tok = h.tok THEN coalesce(lag(l.v) OVER (PARTITION BY l.conv_id, l.turn ORDER BY l.j), 0) + 1 ELSE l.v END AS c
  FROM lcs l JOIN h ON h.conv_id = l.conv_id AND h.turn = l.turn AND h.i = l.i + 1)),
lv AS (SELECT conv_id, turn, max(v) AS lcs FROM lcs GROUP BY ALL),
b AS (SELECT tk.conv_id, tk.turn, a, r, coalesce(clipped, 0) AS clipped, coalesce(lcs, 0) AS lcs, len(list_intersect(list_distinct(a), list_distinct(r))) AS common, len(list_distinct(a)) AS na, len(list_distinct(r)) AS nr
  FROM tk LEFT JOIN clip USING (conv_id, turn) LEFT JOIN lv USING (conv_id, turn))
SELECT conv_id, turn, CASE WHEN common = 0 THEN 0 ELSE round(2 * (common / nr) * (common / na) / (common / nr + common / na), 6) END::DOUBLE AS faithfulness,
  CASE WHEN nr = 0 THEN 0 ELSE round(common / nr, 6) END::DOUBLE AS completeness,
  CASE WHEN lcs = 0 THEN 0 ELSE round(2 * (lcs / len(r)) * (lcs / len(a)) / (lcs / len(r) + lcs / len(a)), 6) END::DOUBLE AS rouge_l,
  CASE WHEN len(a) = 0 OR len(r) = 0 THEN 0 ELSE round(CASE WHEN len(a) >= len(r) THEN 1 ELSE exp(1 - len(r) / len(a)) END * clipped / len(a), 6) END::DOUBLE AS bleu_1 FROM b"""


@query("e8_text_metrics", _token_sql())
def text_metrics(t: Tables):
    """Each turn as the answer, the turn after it as the reference and question."""
    from corpusloom.operators import metrics

    a = t.conversations.select("conv_id", "turn", F.col("text").alias("hyp"))
    b = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ref"))
    return metrics.text_metrics(a.join(b, ["conv_id", "turn"]), ["conv_id", "turn"])
