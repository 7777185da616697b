"""Registered queries: contexts, answer metrics and reports over three retrieval scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import lexicon
from corpusloom.functions.words import eval_tokens
from corpusloom.operators import context, dense, lexical, metrics, reports
from corpusloom.plans import sqltext as s
from corpusloom.plans.inputs import benchmark_questions, document_chunks, with_hashed
from corpusloom.operators.sizing import small
from corpusloom.plans.registry import Tables, query
from corpusloom.settings import DEFAULTS

K = DEFAULTS.top_k
SCENARIOS = ["none", "lexical", "dense"]


def etok(c: str) -> str:
    return f"list_filter({s.words(c)}, lambda t: len(t) > 2 AND t NOT IN {s.in_list(lexicon.METRIC_STOPWORDS)})"


@query("e1_eval_tokens", f"SELECT doc_id, t AS token, count(*) AS n FROM (SELECT doc_id, unnest({etok('text')}) AS t FROM documents) GROUP BY ALL")
def eval_token_counts(t: Tables):
    return (
        t.documents.select("doc_id", F.explode(eval_tokens(F.col("text"))).alias("token"))
        .groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))
    )


def _lexical_hits(t: Tables):
    """Best chunks per question with their text, source and vector."""
    hits = lexical.bm25_top(benchmark_questions(t), document_chunks(t), K)
    return document_chunks(t).drop("collection").join(small(hits.drop("collection")), "chunk_id").withColumnRenamed("text", "content")


def _dense_hits(t: Tables):
    hits = dense.retrieve(with_hashed(benchmark_questions(t)), with_hashed(document_chunks(t)), K)
    return document_chunks(t).drop("collection").join(
        small(hits.drop("collection", "distance")), "chunk_id"
    ).withColumnRenamed("text", "content")


LEX_HITS = (
    f"lex_hits AS (SELECT question_id, rank, chunk_id, source, score, text AS content FROM ({s.best('bm', 'question_id', 'score DESC, chunk_id', K)}) "
    "JOIN chunks USING (chunk_id))"
)
DENSE_HITS = (
    f"dense_hits AS (SELECT question_id, rank, chunk_id, source, round(1 / (1 + distance), 4) AS score, text AS content "
    f"FROM ({s.best('dist', 'question_id', 'distance, chunk_id', K)}) JOIN chunks USING (chunk_id) WHERE 1 / (1 + distance) >= 0.2)"
)


@query(
    "r22_context",
    f"WITH {s.DOCS}, {s.ASKED}, {s.lexical()}, {LEX_HITS} "
    "SELECT question_id, string_agg('[Source ' || rank || ' — ' || source || ' (txt)]:' || chr(10) || content, "
    "chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM lex_hits GROUP BY question_id",
)
def question_context(t: Tables):
    hits = _lexical_hits(t).withColumn("doc_type", F.lit("txt"))
    return context.build(hits, context.source_block())


@query(
    "r22_scored_context",
    f"WITH {s.DOCS}, {s.ASKED}, {s.lexical()}, {s.distances()}, {DENSE_HITS} "
    "SELECT question_id, string_agg('[Sumber ' || rank || ': ' || source || ', Halaman ' || (length(content) % 30 + 1) || ' | Skor: ' || "
    "printf('%.3f', round(score, 3)) || ']' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context "
    "FROM dense_hits GROUP BY question_id",
)
def scored_context(t: Tables):
    hits = _dense_hits(t).withColumn("page", F.length("content") % 30).withColumn("score", F.round("score", 3))
    return context.build(hits, context.scored_block())


@query(
    "r22_typed_context",
    f"WITH {s.DOCS}, {s.ASKED}, {s.lexical()}, {LEX_HITS} "
    "SELECT question_id, string_agg('[' || CASE source WHEN 'src1' THEN 'Chat' WHEN 'src2' THEN 'Database' WHEN 'src3' THEN 'Source' ELSE 'Document' END "
    "|| ' ' || rank || ']:' || chr(10) || left(content, 500), chr(10) || chr(10) ORDER BY rank) AS context FROM lex_hits GROUP BY question_id",
)
def typed_context(t: Tables):
    kind = F.when(F.col("source") == "src1", "chat").when(F.col("source") == "src2", "database").when(
        F.col("source") == "src3", "other"
    ).otherwise("pdf")
    hits = _lexical_hits(t).withColumn("type", kind)
    return hits.groupBy("question_id").agg(context.in_order(context.typed_block(), "\n\n").alias("context"))


def first_sentences(c):
    return F.array_join(F.slice(F.split(c, r"\."), 1, 2), ".")


NO_HITS = "question_id long, rank int, content string, source string, score double, vec array<float>"


def _scenario_inputs(t: Tables, scenario: str):
    asked = benchmark_questions(t)
    if scenario == "none":
        answers = asked.select("question_id", F.col("text").alias("answer"), F.col("text").alias("gold"))
        nothing = t.spark.createDataFrame([], NO_HITS)
        return nothing, answers
    hits = _lexical_hits(t) if scenario == "lexical" else _dense_hits(t)
    top = hits.filter(F.col("rank") == 1).join(
        t.labels.select(F.col("doc_id").alias("chunk_id"), "quality"), "chunk_id", "left"
    ).select("question_id", first_sentences(F.col("content")).alias("answer"), "quality")
    answers = asked.join(top, "question_id", "left").select(
        "question_id", F.coalesce("answer", F.lit("")).alias("answer"), F.when(F.col("quality") == 1, F.col("text")).alias("gold")
    )
    vectors = with_hashed(hits.withColumnRenamed("content", "text")).withColumnRenamed("text", "content")
    return vectors, answers


def scored(t: Tables, scenario: str, positive: bool = False):
    hits, answers = _scenario_inputs(t, scenario)
    relevant = F.col("score") > 0 if positive else None
    rows = metrics.score_answers(with_hashed(benchmark_questions(t)), hits, answers, K, relevant)
    return metrics.with_composites(rows).withColumn("scenario", F.lit(scenario))


def all_scored(t: Tables):
    return reports.union_all([scored(t, x) for x in SCENARIOS])


def scored_sql(scenarios: list[str], relevant: str = "score >= 0.2") -> str:
    """CTEs up to ``scored`` with one row per scenario and question."""
    parts = {
        "none": "SELECT 'none' AS scenario, question_id, 0 AS rank, 0 AS chunk_id, '' AS source, 0.0::DOUBLE AS score, '' AS content FROM questions WHERE false",
        "lexical": "SELECT 'lexical' AS scenario, question_id, rank, chunk_id, source, score, content FROM lex_hits",
        "dense": "SELECT 'dense' AS scenario, question_id, rank, chunk_id, source, score, content FROM dense_hits",
    }
    names = ", ".join(f"('{x}')" for x in scenarios)
    return f"""{s.DOCS}, {s.ASKED}, {s.lexical()}, {s.distances()}, {LEX_HITS}, {DENSE_HITS},
hits AS MATERIALIZED ({' UNION ALL '.join(parts[x] for x in scenarios)}),
runs AS (SELECT scenario, question_id, text FROM questions, (VALUES {names}) v(scenario)),
ans AS (SELECT r.scenario, r.question_id, r.text,
   CASE WHEN r.scenario = 'none' THEN r.text ELSE coalesce(array_to_string(string_split(content, '.')[1:2], '.'), '') END AS answer,
   CASE WHEN r.scenario = 'none' OR quality = 1 THEN r.text END AS gold
   FROM runs r LEFT JOIN (SELECT * FROM hits WHERE rank = 1) h USING (scenario, question_id) LEFT JOIN labels l ON l.doc_id = h.chunk_id),
ctx AS (SELECT scenario, question_id, string_agg(content, ' ' ORDER BY rank) AS context, count(*) AS n, count(DISTINCT source) AS n_sources,
   sum(CASE WHEN {relevant} THEN 1 ELSE 0 END) AS n_rel, min(CASE WHEN {relevant} THEN rank END) AS first_rel, avg(score) AS mean_score FROM hits GROUP BY ALL),
mv AS (SELECT scenario, question_id, b, sum(v) / max(n) AS v FROM hits JOIN cv USING (chunk_id) JOIN ctx USING (scenario, question_id) GROUP BY ALL),
cosv AS (SELECT m.scenario, m.question_id, sum(m.v * coalesce(q.v, 0)) AS dot, sum(m.v * m.v) AS mm FROM mv m LEFT JOIN qv q ON q.question_id = m.question_id AND q.b = m.b GROUP BY ALL),
toks AS MATERIALIZED (SELECT scenario, question_id, answer, gold, trim(answer) <> '' AS answered, {etok('text')} AS q, {etok('answer')} AS a,
   {etok("coalesce(context, '')")} AS c, {etok("coalesce(nullif(gold, ''), context, '')")} AS ref, coalesce(n, 0) AS n, n_sources, n_rel, first_rel, mean_score
   FROM ans LEFT JOIN ctx USING (scenario, question_id)),
sets AS MATERIALIZED (SELECT scenario, question_id, list_distinct(q) AS qs, list_distinct(a) AS s_a, list_distinct(c) AS cs,
   len(list_intersect(list_distinct(q), list_distinct(a))) AS qa, len(list_intersect(list_distinct(a), list_distinct(c))) AS ac FROM toks),
hyp AS MATERIALIZED (SELECT scenario, question_id, unnest(a) AS tok, generate_subscripts(a, 1) AS i FROM toks),
refs AS MATERIALIZED (SELECT scenario, question_id, unnest(ref) AS tok, generate_subscripts(ref, 1) AS j FROM toks),
clip AS (SELECT scenario, question_id, sum(least(x.n, y.n)) AS clipped FROM (SELECT scenario, question_id, tok, count(*) AS n FROM hyp GROUP BY ALL) x
   JOIN (SELECT scenario, question_id, tok, count(*) AS n FROM refs GROUP BY ALL) y USING (scenario, question_id, tok) GROUP BY ALL),
lcs AS (SELECT 0 AS i, scenario, question_id, j, tok, 0 AS v FROM refs
   UNION ALL
   SELECT i, scenario, question_id, j, tok, max(c) OVER (PARTITION BY scenario, question_id ORDER BY j) AS v FROM (
     SELECT l.i + 1 AS i, l.scenario, l.question_id, l.j, l.tok,
       CASE WHEN l.tok = h.tok THEN coalesce(lag(l.v) OVER (PARTITION BY l.scenario, l.question_id ORDER BY l.j), 0) + 1 ELSE l.v END AS c
     FROM lcs l JOIN hyp h ON h.scenario = l.scenario AND h.question_id = l.question_id AND h.i = l.i + 1)),
lcsv AS (SELECT scenario, question_id, max(v) AS lcs FROM lcs GROUP BY ALL),
raw AS (SELECT t.scenario, t.question_id, t.answer, coalesce(t.gold, '') AS gold, t.n AS chunks,
   CASE WHEN t.n = 0 THEN 0 WHEN coalesce(cosv.mm, 0) = 0 OR coalesce(qn.n2, 0) = 0 THEN 0 ELSE greatest(0, least(1, dot / (sqrt(qn.n2) * sqrt(cosv.mm)))) END AS retrieval_relevance,
   CASE WHEN t.n = 0 OR NOT answered OR ac = 0 THEN 0 ELSE 2 * (ac / len(cs)) * (ac / len(s_a)) / (ac / len(cs) + ac / len(s_a)) END AS answer_faithfulness,
   CASE WHEN answered AND len(qs) > 0 THEN qa / len(qs) ELSE 0 END AS answer_completeness,
   CASE WHEN coalesce(lcs, 0) = 0 OR len(a) = 0 THEN 0 ELSE 2 * (lcs / len(ref)) * (lcs / len(a)) / (lcs / len(ref) + lcs / len(a)) END AS rouge_l,
   CASE WHEN len(a) > 0 AND len(ref) > 0 THEN CASE WHEN len(a) >= len(ref) THEN 1 ELSE exp(1 - len(ref) / len(a)) END * coalesce(clipped, 0) / len(a) ELSE 0 END AS bleu_1,
   coalesce(n_rel, 0) / {K} AS precision_at_k, coalesce(1 / first_rel, 0) AS mrr, coalesce(n_sources / t.n, 0) AS context_coverage, coalesce(mean_score, 0) AS avg_chunk_score
   FROM toks t JOIN sets USING (scenario, question_id) LEFT JOIN clip USING (scenario, question_id) LEFT JOIN lcsv USING (scenario, question_id)
   LEFT JOIN cosv USING (scenario, question_id) LEFT JOIN qn ON qn.question_id = t.question_id),
rounded AS (SELECT scenario, question_id, answer, gold, chunks, {', '.join(f'round({m}, 3)::DOUBLE AS {m}' for m in metrics.METRICS if m != 'overall')},
   round((retrieval_relevance + answer_faithfulness + answer_completeness + rouge_l + bleu_1) / 5, 3)::DOUBLE AS overall FROM raw),
scored AS MATERIALIZED (SELECT *, round((answer_faithfulness + answer_completeness) / 2, 4) AS kte, round((precision_at_k + context_coverage) / 2, 4) AS msrs,
   round((answer_faithfulness + answer_completeness + rouge_l) / 3, 4) AS aqi FROM rounded)"""


def with_scored(scenarios, tail: str, relevant: str = "score >= 0.2") -> str:
    return "WITH RECURSIVE " + scored_sql(scenarios, relevant) + " " + tail


ROW_COLUMNS = ", ".join(["scenario", "question_id", *metrics.METRICS, "kte", "msrs", "aqi", "chunks", "answer", "gold"])


@query("e12_score_rows_dense", with_scored(["dense"], f"SELECT {ROW_COLUMNS} FROM scored"))
def score_rows_dense(t: Tables):
    return scored(t, "dense")


@query("e13_score_rows_lexical", with_scored(["lexical"], f"SELECT {ROW_COLUMNS} FROM scored", "score > 0"))
def score_rows_lexical(t: Tables):
    return scored(t, "lexical", positive=True)


@query("e14_score_rows_no_retrieval", with_scored(["none"], f"SELECT {ROW_COLUMNS} FROM scored"))
def score_rows_none(t: Tables):
    return scored(t, "none")


@query(
    "e10_overall_of_three",
    with_scored(["lexical"], "SELECT question_id, round((retrieval_relevance + answer_faithfulness + answer_completeness) / 3, 4) AS overall3, "
    "CASE WHEN overall >= 0.7 THEN '[BAIK]' WHEN overall >= 0.4 THEN '[CUKUP]' ELSE '[RENDAH]' END AS grade FROM scored"),
)
def overall_of_three(t: Tables):
    rows = scored(t, "lexical")
    return rows.select(
        "question_id", F.round(metrics.overall_of_three(rows), 4).alias("overall3"), metrics.grade(F.col("overall")).alias("grade")
    )


def _means(cols, digits=3):
    return ", ".join(f"round(avg({c}), {digits}) AS {c}" for c in cols)


@query("a2_scenario_means", with_scored(SCENARIOS, f"SELECT scenario, {_means(reports.SUMMARY)} FROM scored GROUP BY scenario"))
def scenario_means(t: Tables):
    return reports.means(all_scored(t), ["scenario"])


SUMMARY_SQL = (
    "count(*) AS n, round(avg(overall), 3) AS overall, round((avg(answer_faithfulness) + avg(answer_completeness)) / 2, 3) AS kte, "
    "round((avg(precision_at_k) + avg(context_coverage)) / 2, 3) AS msrs, "
    "round((avg(answer_faithfulness) + avg(answer_completeness) + avg(rouge_l)) / 3, 3) AS aqi"
)


@query("a3_scenario_summary", with_scored(SCENARIOS, f"SELECT scenario, {SUMMARY_SQL} FROM scored GROUP BY scenario"))
def scenario_summary(t: Tables):
    return reports.summary(all_scored(t), ["scenario"])


@query(
    "a4_subtype_summary",
    with_scored(SCENARIOS, f"SELECT scenario, CASE WHEN gold = '' THEN 'free' ELSE 'with gold' END AS subtype, {SUMMARY_SQL} FROM scored GROUP BY ALL"),
)
def subtype_summary(t: Tables):
    rows = all_scored(t).withColumn("subtype", F.when(F.col("gold") == "", "free").otherwise("with gold"))
    return reports.summary(rows, ["scenario", "subtype"])


BATCH = ["retrieval_relevance", "answer_faithfulness", "answer_completeness", "rouge_l", "bleu_1", "precision_at_k", "mrr", "overall"]


@query("a5_batch_means", with_scored(["lexical"], f"SELECT {_means(BATCH)} FROM scored"))
def batch_means(t: Tables):
    return reports.means(scored(t, "lexical"), [], BATCH)


ABLATION_SQL = (
    ", sm AS (SELECT scenario, CASE scenario WHEN 'none' THEN 0 WHEN 'lexical' THEN 1 ELSE 2 END AS step, "
    "round((avg(answer_faithfulness) + avg(answer_completeness)) / 2, 3) AS kte FROM scored GROUP BY scenario)"
)


def _ablation(t: Tables):
    step = F.when(F.col("scenario") == "none", 0).when(F.col("scenario") == "lexical", 1).otherwise(2)
    return reports.ablation(reports.summary(all_scored(t), ["scenario"]).select("scenario", step.alias("step"), "kte"))


@query(
    "w2_ablation_steps",
    with_scored(SCENARIOS, ABLATION_SQL + " SELECT scenario, step, kte, round(coalesce(kte - lag(kte) OVER (ORDER BY step), 0), 3) AS delta, "
    "round(kte - first_value(kte) OVER (ORDER BY step), 3) AS cumulative FROM sm"),
)
def ablation_steps(t: Tables):
    return _ablation(t)


@query(
    "w2_dominant_step",
    with_scored(SCENARIOS, ABLATION_SQL + ", st AS (SELECT *, round(coalesce(kte - lag(kte) OVER (ORDER BY step), 0), 3) AS delta FROM sm) "
    "SELECT scenario AS dominant FROM st WHERE step >= 1 ORDER BY delta DESC, step LIMIT 1"),
)
def dominant_step(t: Tables):
    return reports.dominant(_ablation(t), first_step=1)


@query(
    "e16_score_pivot",
    with_scored(SCENARIOS, "SELECT question_id, " + ", ".join(f"max(CASE WHEN scenario = '{x}' THEN overall END) AS s_{x}" for x in SCENARIOS)
    + " FROM scored GROUP BY question_id"),
)
def score_pivot(t: Tables):
    wide = reports.pivot_scenarios(all_scored(t), SCENARIOS, F.col("overall"))
    return wide.select("question_id", *[F.col(x).alias(f"s_{x}") for x in SCENARIOS])


@query(
    "w3_renumbered",
    "SELECT event_type AS scenario, event_id AS no, row_number() OVER (ORDER BY event_type, event_id) AS new_no FROM events",
)
def renumbered(t: Tables):
    rows = t.events.select(F.col("event_type").alias("scenario"), F.col("event_id").alias("no"))
    return reports.renumbered(rows).select("scenario", "no", F.col("new_no").cast("long").alias("new_no"))
