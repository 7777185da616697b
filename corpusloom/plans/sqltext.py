"""Fragments for the SQL forms of the registered queries."""

from __future__ import annotations

W = r"[\p{L}\p{N}_]+"


def words(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '{W}')"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(items) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


def any_of(c: str, needles) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(n)})" for n in needles) + ")"


def hits_of(c: str, needles) -> str:
    return "(" + " + ".join(f"contains({c}, {q(n)})::INT" for n in needles) + ")"


def matches_any(c: str, patterns) -> str:
    return f"regexp_matches({c}, {q('|'.join(f'(?:{p})' for p in patterns))})"


def best(cte: str, keys: str, order: str, k, rank: str = "rank", cols: str = "*") -> str:
    return (
        f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS {rank} FROM {cte})"
        f" WHERE {rank} <= {k}"
    )


def lexical(chunks: str = "chunks", questions: str = "questions") -> str:
    """CTEs up to ``bm(question_id, collection, chunk_id, score)``."""
    return f"""
tok AS MATERIALIZED (SELECT collection, chunk_id, {words('text')} AS toks FROM {chunks}),
totals AS (SELECT collection, count(*) AS n, sum(len(toks)) / count(*) AS avg_tokens FROM tok GROUP BY collection),
tf AS MATERIALIZED (SELECT collection, chunk_id, n_tokens, term, count(*) AS tf
       FROM (SELECT collection, chunk_id, len(toks) AS n_tokens, unnest(toks) AS term FROM tok) GROUP BY ALL),
df AS (SELECT collection, term, count(*) AS df FROM tf GROUP BY ALL),
rawidf AS (SELECT collection, term, df, n, avg_tokens, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df JOIN totals USING (collection)),
floors AS (SELECT collection, 0.25 * avg(idf) AS floor FROM rawidf GROUP BY collection),
weights AS (SELECT collection, term, df, avg_tokens, CASE WHEN idf < 0 THEN floor ELSE idf END AS weight
            FROM rawidf JOIN floors USING (collection)),
qt AS (SELECT question_id, term, count(*) AS qtf
       FROM (SELECT question_id, unnest({words('text')}) AS term FROM {questions}) GROUP BY ALL),
bm AS MATERIALIZED (SELECT question_id, collection, chunk_id, round(sum(qtf * weight * tf * 2.5
         / (tf + 1.5 * (0.25 + 0.75 * n_tokens / avg_tokens))), 6) AS score
       FROM tf JOIN weights USING (collection, term) JOIN qt USING (term)
       GROUP BY question_id, collection, chunk_id HAVING score > 0)"""


def vectors(name: str, table: str, key: str, text: str = "text", keep: str = "") -> str:
    """CTE ``name(key, b, v)``: sparse unit vectors of hashed words; blank texts have no rows."""
    keep = keep + "," if keep else ""
    return f"""
{name} AS MATERIALIZED (SELECT {keep} {key}, b, (c / sqrt(sum(c * c) OVER (PARTITION BY {keep} {key})))::FLOAT::DOUBLE AS v
  FROM (SELECT {keep} {key}, b, count(*)::DOUBLE AS c
        FROM (SELECT {keep} {key}, ('0x' || substr(md5(t), 1, 4))::INT % 64 AS b
              FROM (SELECT {keep} {key}, unnest({words(text)}) AS t FROM {table})) GROUP BY ALL))"""


def distances(chunks: str = "chunks", questions: str = "questions") -> str:
    """CTEs up to ``dist(question_id, collection, chunk_id, distance)`` over hashed vectors."""
    return (
        vectors("cv", chunks, "chunk_id", keep="collection")
        + ","
        + vectors("qv", questions, "question_id")
        + f""",
cn AS (SELECT collection, chunk_id, sum(v * v) AS n2 FROM cv GROUP BY ALL),
qn AS (SELECT question_id, sum(v * v) AS n2 FROM qv GROUP BY ALL),
dots AS (SELECT question_id, collection, chunk_id, sum(qv.v * cv.v) AS dot FROM cv JOIN qv USING (b) GROUP BY ALL),
dist AS MATERIALIZED (SELECT q.question_id, c.collection, c.chunk_id,
    round(greatest(coalesce(qn.n2, 0) + coalesce(cn.n2, 0) - 2 * coalesce(dot, 0), 0), 9) AS distance
  FROM {questions} q CROSS JOIN {chunks} c
  LEFT JOIN qn USING (question_id) LEFT JOIN cn USING (collection, chunk_id)
  LEFT JOIN dots USING (question_id, collection, chunk_id))"""
    )


def fused(k: int, pool: int, chunks: str = "chunks", near: int | None = None) -> str:
    """CTEs from ``bm`` and ``dist`` up to ``fused(question_id, collection, place, chunk_id, source, shown, fused)``."""
    return f"""
dense AS ({best('dist', 'question_id, collection', 'distance, chunk_id', near or k, 'rank', '*, 1 / (1 + distance) AS similarity')}),
lex AS ({best('bm', 'question_id, collection', 'score DESC, chunk_id', pool)}),
sims AS (SELECT question_id, collection, greatest(min(similarity), 0.1) AS floor FROM dense GROUP BY ALL),
contrib AS (SELECT question_id, collection, chunk_id, 0 AS origin, rank, 1.0 / (60 + rank)::DOUBLE AS share, similarity AS shown FROM dense
  UNION ALL SELECT question_id, collection, chunk_id, 1, rank, 1.0 / (60 + rank)::DOUBLE, coalesce(floor, 0.1)
  FROM lex LEFT JOIN sims USING (question_id, collection)),
keyed AS (SELECT contrib.*, source, row_number() OVER (PARTITION BY question_id, collection, chunk_id ORDER BY origin, rank) AS nth
  FROM contrib JOIN {chunks} USING (collection, chunk_id)),
summed AS (SELECT question_id, collection, chunk_id, round(sum(share), 9) AS fused,
    min(CASE WHEN origin = 1 THEN rank END) AS lexical_rank FROM keyed GROUP BY ALL),
reps AS (SELECT s.*, k.origin, k.rank, k.source, k.shown FROM summed s
  JOIN keyed k USING (question_id, collection, chunk_id) WHERE nth = 1),
overs AS (SELECT *, (row_number() OVER (PARTITION BY question_id, collection, source
    ORDER BY fused DESC, origin, rank, chunk_id) > 2)::INT AS over FROM reps),
placed AS (SELECT *, row_number() OVER (PARTITION BY question_id, collection
    ORDER BY over, fused DESC, origin, rank, chunk_id) AS p0 FROM overs),
lifted AS (SELECT *, CASE WHEN {k} > 1 AND lexical_rank = 1 AND p0 > {k} THEN {k}
    WHEN {k} > 1 AND p0 = {k} AND max(CASE WHEN lexical_rank = 1 THEN p0 END) OVER (PARTITION BY question_id, collection) > {k}
    THEN {k} + 1 ELSE p0 END AS place FROM placed),
fused AS MATERIALIZED (SELECT question_id, collection, place, chunk_id, source, round(shown, 6) AS shown, fused FROM lifted WHERE place <= {k})"""


DOCS = "chunks AS (SELECT 'all' AS collection, doc_id AS chunk_id, text, source FROM documents)"
DOCS_BY_LANG = "chunks AS (SELECT lang AS collection, doc_id AS chunk_id, text, source FROM documents)"
ASKED = "questions AS (SELECT item_id AS question_id, text FROM benchmark)"


def stem(c: str, suffixes, prefixes) -> str:
    base = f"trim(lower({c}))"
    tailless = "CASE " + " ".join(
        f"WHEN ends_with({base}, '{x}') AND len({base}) > {len(x) + 2} THEN left({base}, len({base}) - {len(x)})"
        for x in suffixes
    ) + f" ELSE {base} END"
    return "CASE " + " ".join(
        f"WHEN starts_with(({tailless}), '{p}') AND len({tailless}) > {len(p) + 2} THEN substr(({tailless}), {len(p) + 1})"
        for p in prefixes
    ) + f" ELSE {tailless} END"


PART_QUESTIONS = """questions AS (SELECT p_partkey AS question_id, CASE p_size % 10
  WHEN 0 THEN 'Berapa harga ' || p_name || '?'
  WHEN 1 THEN 'Jelaskan tentang ' || p_name || ' dari file catalog_' || p_brand
  WHEN 2 THEN 'Bandingkan ' || p_name || ' lebih murah mana vs ' || p_type
  WHEN 3 THEN 'Siapa yang handle ' || p_name || ' di departemen IT atau Finance Manager'
  WHEN 4 THEN 'Hitung total order dan jumlah stok ' || p_name
  WHEN 5 THEN 'Apa itu proses auction dan settlement ' || p_name
  WHEN 6 THEN 'Average price of product ' || p_name || ' by Project Manager and QA lead'
  WHEN 7 THEN 'Tampilkan data karyawan Engineer ' || p_name || ' Rp 500.000 dan 5 juta sejak 12/03/2024 nomor ' || p_size
  WHEN 8 THEN 'Explain the conversation about ' || p_name || ' in notes_' || p_size || '.txt email kontak'
  ELSE split_part(p_name, ' ', 2) || ' ' || p_size END AS text FROM part)"""

SP = r"[\s\x0b\x1c-\x1f\x{0085}\p{Z}]"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SP}+|{SP}+$', '', 'g')"


def split_words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{SP}+'), lambda w: w <> '')"
