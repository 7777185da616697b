"""Registered queries: search in tables, tables as text and aggregates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom import lexicon
from corpusloom.functions import questions as qf
from corpusloom.functions.words import words
from corpusloom.operators import tables as tb
from corpusloom.operators import trigrams
from corpusloom.operators.ordering import balanced
from corpusloom.operators.sizing import shared_folder
from corpusloom.plans import sqltext as s
from corpusloom.plans.question_queries import TERMS, _expanded_terms
from corpusloom.plans.registry import Tables, query

# one question per supplier, about the part with the same number
ASKED_SQL = """questions AS (SELECT s_suppkey AS question_id, CASE s_nationkey % 3
  WHEN 0 THEN 'cari data ' || p_name || ' project manager'
  WHEN 1 THEN 'harga ' || p_type || ' ' || p_brand
  ELSE 'xq' || s_suppkey || ' ' || substr(split_part(p_name, ' ', 2), 2) END AS text
  FROM supplier JOIN part ON p_partkey = s_suppkey)"""


def asked(t: Tables):
    return t.supplier.join(t.part, F.col("p_partkey") == F.col("s_suppkey")).select(
        F.col("s_suppkey").alias("question_id"),
        F.when(F.col("s_nationkey") % 3 == 0, F.concat(F.lit("cari data "), "p_name", F.lit(" project manager")))
        .when(F.col("s_nationkey") % 3 == 1, F.concat(F.lit("harga "), "p_type", F.lit(" "), "p_brand"))
        .otherwise(
            F.concat(F.lit("xq"), F.col("s_suppkey").cast("string"), F.lit(" "),
                     F.expr("substring(split_part(p_name, ' ', 2), 2)"))
        ).alias("text"),
    )


def with_terms(questions):
    terms = qf.expanded_terms(qf.search_terms(F.col("text")))
    return questions.select("question_id", terms.alias("terms")).withColumn("phrases", qf.phrases(F.col("terms")))


def searchables(t: Tables):
    return [
        tb.Searchable("part", t.part, "p_partkey", ("p_name", "p_brand", "p_type"), "p_name"),
        tb.Searchable("customer", t.customer, "c_custkey", ("c_name", "c_mktsegment"), "c_name"),
        tb.Searchable("orders", t.orders, "o_orderkey", ("o_orderstatus", "o_orderpriority")),
    ]


LAYOUT = {
    "part": ("p_partkey", ["p_name", "p_brand", "p_type"], "p_name"),
    "customer": ("c_custkey", ["c_name", "c_mktsegment"], "c_name"),
    "orders": ("o_orderkey", ["o_orderstatus", "o_orderpriority"], None),
}
TERMS_SQL = f"""{ASKED_SQL},
t0 AS (SELECT question_id, unnest({TERMS}) AS term FROM questions),
t1 AS (SELECT DISTINCT question_id, unnest({_expanded_terms()}) AS term FROM t0),
stm AS (SELECT DISTINCT question_id, {s.stem('term', lexicon.STEM_SUFFIXES_TABLE, lexicon.STEM_PREFIXES)} AS stem FROM t1),
terms AS MATERIALIZED (SELECT question_id, list(term) AS terms FROM t1 GROUP BY question_id),
stems AS MATERIALIZED (SELECT question_id, list(stem) AS stems FROM stm WHERE len(stem) >= 2 GROUP BY question_id),
asked AS MATERIALIZED (SELECT question_id, terms, coalesce(stems, []) AS stems, list_concat({', '.join(
    f"CASE WHEN list_contains(terms, '{a}') AND list_contains(terms, '{b}') THEN ['{a} {b}'] ELSE [] END" for a, b in lexicon.PHRASES)}) AS phrases
  FROM terms LEFT JOIN stems USING (question_id))"""


def _ranked_sql(label: str, limit: int = 10) -> str:
    key, cols, name = LAYOUT[label]
    if name is None:
        return "SELECT question_id, NULL::BIGINT AS row_id, 0.0::DOUBLE AS score FROM asked WHERE false"
    toks = f"regexp_extract_all(lower(concat_ws(' ', {', '.join(cols)})), '{tb.PART}')"
    phrase = " + ".join(f"len(list_filter(phrases, lambda p: contains(lower({c}), p)))" for c in cols)
    return f"""SELECT question_id, row_id, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, row_id) AS rn FROM (
  SELECT question_id, {key} AS row_id, round(hits / len(stems) + 50.0 * in_name + 20.0 * in_phrase, 6)::DOUBLE AS score FROM (
    SELECT question_id, {key}, stems, len(list_filter(stems, lambda x: len(list_filter({toks}, lambda w: starts_with(w, x))) > 0)) AS hits,
      len(list_filter(terms, lambda x: contains(lower({name}), x))) AS in_name, {phrase} AS in_phrase FROM asked, {label})
  WHERE hits > 0)) WHERE rn <= {limit}"""


def _parts_sql(label: str, source: str = "asked", limit: int = 10) -> str:
    key, cols, _ = LAYOUT[label]
    points = " + ".join(
        f"len(list_filter(terms, lambda x: contains(lower({c}), x))) + 10 * len(list_filter(phrases, lambda p: contains(lower({c}), p)))" for c in cols
    )
    return f"""SELECT question_id, row_id, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, row_id) AS rn FROM (
  SELECT question_id, {key} AS row_id, ({points})::DOUBLE AS score FROM {source}, {label}) WHERE score > 0) WHERE rn <= {limit}"""


@query("r12_word_search", f"WITH {TERMS_SQL} {_ranked_sql('part')}")
def word_search(t: Tables):
    hits = tb.search_ranked(with_terms(asked(t)), searchables(t)[0])
    return hits.withColumn("row_id", F.col("row_id").cast("long"))


@query("r13_substring_search", f"WITH {TERMS_SQL} {_parts_sql('part')}")
def substring_search(t: Tables):
    hits = tb.search_parts(with_terms(asked(t)), searchables(t)[0])
    return hits.withColumn("row_id", F.col("row_id").cast("long"))


MULTIWORD_SQL = """asked AS (SELECT s_suppkey AS question_id, list_distinct([lower(substr(p_name, 3, 8)), lower(p_brand), lower(p_type)]) AS terms, []::VARCHAR[] AS stems, []::VARCHAR[] AS phrases
  FROM supplier JOIN part ON p_partkey = s_suppkey)"""


@query("r13_multiword_search", f"WITH {MULTIWORD_SQL} {_parts_sql('part')}")
def multiword_search(t: Tables):
    """Terms with blanks and signs inside, as a substring search finds them."""
    made = t.supplier.join(t.part, F.col("p_partkey") == F.col("s_suppkey")).select(
        F.col("s_suppkey").alias("question_id"),
        F.array_distinct(F.array(F.lower(F.substring("p_name", 3, 8)), F.lower("p_brand"), F.lower("p_type"))).alias("terms"),
        F.array().cast("array<string>").alias("phrases"))
    return tb.search_parts(made, searchables(t)[0]).withColumn("row_id", F.col("row_id").cast("long"))


SIGNS_SQL = """asked AS (SELECT s_suppkey AS question_id, list_distinct(CASE s_suppkey % 4
    WHEN 0 THEN ['#', lower(p_brand)] WHEN 1 THEN [lower(substr(p_name, 3, 8)), 'zz', '%'] WHEN 2 THEN ['d#1', lower(p_type), '-'] ELSE [substr(lower(p_type), 1, 2), '#1'] END) AS terms,
    []::VARCHAR[] AS stems, CASE WHEN s_suppkey % 2 = 0 THEN [lower(p_name)] ELSE [] END AS phrases
  FROM supplier JOIN part ON p_partkey = s_suppkey)"""


@query("r13_trigram_search", f"WITH {SIGNS_SQL} " + " UNION ALL ".join(f"SELECT question_id, '{n}' AS \"table\", row_id, score FROM ({_parts_sql(n)})" for n in LAYOUT))
def trigram_search(t: Tables):
    """Terms of signs, of one and two characters, of several words, in three tables at once."""
    case, name, brand, kind = F.col("s_suppkey") % 4, F.lower("p_name"), F.lower("p_brand"), F.lower("p_type")
    terms = (
        F.when(case == 0, F.array(F.lit("#"), brand)).when(case == 1, F.array(F.substring(name, 3, 8), F.lit("zz"), F.lit("%")))
        .when(case == 2, F.array(F.lit("d#1"), kind, F.lit("-"))).otherwise(F.array(F.substring(kind, 1, 2), F.lit("#1")))
    )
    made = t.supplier.join(t.part, F.col("p_partkey") == F.col("s_suppkey")).select(
        F.col("s_suppkey").alias("question_id"), F.array_distinct(terms).alias("terms"),
        F.when(F.col("s_suppkey") % 2 == 0, F.array(name)).otherwise(F.array().cast("array<string>")).alias("phrases"))
    place = f"{shared_folder(t.spark).rstrip('/')}/grams-{uuid.uuid4().hex}"
    trigrams.save_tables(searchables(t), place)
    return trigrams.search_indexed(made, place).withColumn("row_id", F.col("row_id").cast("long"))


def _searched_sql() -> str:
    ctes, unions = [], []
    for label in LAYOUT:
        ctes.append(f"f_{label} AS MATERIALIZED ({_ranked_sql(label)})")
        ctes.append(f"a_{label} AS (SELECT * FROM asked WHERE question_id NOT IN (SELECT question_id FROM f_{label}))")
        ctes.append(f"p_{label} AS ({_parts_sql(label, f'a_{label}')})")
        unions.append(f"SELECT *, '{label}' AS \"table\" FROM f_{label} UNION ALL SELECT *, '{label}' FROM p_{label}")
    return ", ".join(ctes), " UNION ALL ".join(unions)


CTES, UNIONS = _searched_sql()


@query("r14_table_search", f"WITH {TERMS_SQL}, {CTES} {UNIONS}")
def table_search(t: Tables):
    hits = tb.search_tables(with_terms(asked(t)), searchables(t))
    return hits.withColumn("row_id", F.col("row_id").cast("long"))


def _all_words_sql() -> str:
    parts = []
    for label, (key, cols, _) in LAYOUT.items():
        toks = f"regexp_extract_all(lower(concat_ws(' ', {', '.join(cols)})), '{tb.PART}')"
        parts.append(
            f"SELECT question_id, {key} AS row_id, '{label}' AS \"table\" FROM wq, {label} WHERE len(list_filter(ws, lambda w: NOT list_contains({toks}, w))) = 0"
        )
    return " UNION ALL ".join(parts)


@query(
    "r15_all_words_search",
    "WITH wq AS (SELECT s_suppkey AS question_id, regexp_extract_all(lower(p_name || ' ' || p_type), '[\\p{L}\\p{N}_]+') AS ws FROM supplier JOIN part ON p_partkey = s_suppkey), "
    f"hit AS ({_all_words_sql()}) SELECT question_id, row_id, \"table\", rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY \"table\", row_id) AS rank FROM hit) WHERE rank <= 10",
)
def all_words_search(t: Tables):
    wanted = t.supplier.join(t.part, F.col("p_partkey") == F.col("s_suppkey")).select(
        F.col("s_suppkey").alias("question_id"), words(F.concat("p_name", F.lit(" "), "p_type")).alias("words")
    )
    hits = tb.search_all_words(wanted, searchables(t))
    return hits.withColumn("row_id", F.col("row_id").cast("long"))


# aggregates ---------------------------------------------------------------------------------------

NUMERIC = {
    "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
    "part": ["p_partkey", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
}
AGG_QUESTIONS = """questions AS (SELECT c_custkey AS question_id, CASE c_nationkey % 6
  WHEN 0 THEN 'Berapa total orders dari ' || c_name WHEN 1 THEN 'How many part for ' || c_name
  WHEN 2 THEN 'average o custkey of each order ' || c_name WHEN 3 THEN 'terkecil p_size in part and customer ' || c_mktsegment
  WHEN 4 THEN 'c acctbal tertinggi' ELSE 'nothing to compute here ' || c_name END AS text FROM customer)"""


def agg_questions(t: Tables):
    n = F.col("c_nationkey") % 6
    return t.customer.select(
        F.col("c_custkey").alias("question_id"),
        F.when(n == 0, F.concat(F.lit("Berapa total orders dari "), "c_name"))
        .when(n == 1, F.concat(F.lit("How many part for "), "c_name"))
        .when(n == 2, F.concat(F.lit("average o custkey of each order "), "c_name"))
        .when(n == 3, F.concat(F.lit("terkecil p_size in part and customer "), "c_mktsegment"))
        .when(n == 4, "c acctbal tertinggi")
        .otherwise(F.concat(F.lit("nothing to compute here "), "c_name")).alias("text"),
    )


def _resolved_sql() -> str:
    kind = "CASE " + " ".join(f"WHEN {s.any_of('lower(text)', ws)} THEN '{n}'" for n, ws in lexicon.AGGREGATE_WORDS.items()) + " END"
    parts = []
    for label, cols in NUMERIC.items():
        usual = [c for c in cols if any(m in c for m in lexicon.MEASURE_WORDS)]
        col = "CASE " + " ".join(
            f"WHEN contains(lower(text), '{c}') OR contains(lower(text), '{c.replace('_', ' ')}') THEN '{c}'" for c in cols
        ) + f" ELSE '{(usual or cols)[0]}' END"
        parts.append(
            f"SELECT question_id, {kind} AS agg, '{label}' AS \"table\", {col} AS col0 FROM questions "
            f"WHERE contains(lower(text), '{label}') OR contains(lower(text), '{label.rstrip('s')}')"
        )
    return f"res0 AS ({' UNION ALL '.join(parts)}), res AS (SELECT question_id, agg, \"table\", CASE WHEN agg = 'COUNT' THEN '*' ELSE col0 END AS \"column\" FROM res0 WHERE agg IS NOT NULL)"


@query("q12_resolved_aggregates", f"WITH {AGG_QUESTIONS}, {_resolved_sql()} SELECT * FROM res")
def resolved_aggregates(t: Tables):
    frames = {"customer": t.customer, "part": t.part, "orders": t.orders}
    return qf.resolved_aggregates(agg_questions(t), {n: tb.numeric_columns(f) for n, f in frames.items()})


def _values_sql() -> str:
    rows = []
    for label, cols in NUMERIC.items():
        rows.append(f"SELECT '{label}' AS \"table\", '*' AS \"column\", 'COUNT' AS agg, count(*)::DOUBLE AS value FROM {label}")
        for c in cols:
            for a in ["SUM", "AVG", "MIN", "MAX"]:
                rows.append(f"SELECT '{label}', '{c}', '{a}', {a.lower()}({c})::DOUBLE FROM {label}")
    return f"vals AS ({' UNION ALL '.join(rows)})"


@query(
    "a1_answered_aggregates",
    f"WITH {AGG_QUESTIONS}, {_resolved_sql()}, {_values_sql()} SELECT question_id, agg, \"table\", \"column\", round(value, 2) AS value FROM res JOIN vals USING (\"table\", \"column\", agg)",
)
def answered_aggregates(t: Tables):
    found = tb.answered_aggregates(agg_questions(t), {"customer": t.customer, "part": t.part, "orders": t.orders})
    return found.withColumn("value", F.round("value", 2))


# tables as text -----------------------------------------------------------------------------------


@query(
    "s7_table_blocks",
    "SELECT 'part' AS label, p_partkey // 200 AS block, 'Tabel: part' || chr(10) || chr(10) || '| p_partkey | p_name | p_brand | p_size |' || chr(10) || '|---|---|---|---|' || chr(10) || "
    "string_agg('| ' || p_partkey || ' | ' || replace(replace(p_name || '|', '|', '\\|'), chr(10), ' ') || ' | ' || coalesce(nullif(p_brand, 'Brand#1'), '') || ' | ' || p_size || ' |', chr(10) ORDER BY p_partkey) AS content "
    "FROM part GROUP BY block",
)
def table_blocks(t: Tables):
    rows = t.part.select("p_partkey", F.concat("p_name", F.lit("|")).alias("p_name"), F.nullif("p_brand", F.lit("Brand#1")).alias("p_brand"), "p_size")
    return tb.markdown_blocks(rows, "part", ["p_partkey", "p_name", "p_brand", "p_size"], "p_partkey")


@query(
    "s7_row_blocks",
    "SELECT 'lineitem' AS label, n // 200 AS block, 'Tabel: lineitem' || chr(10) || chr(10) || '| l_orderkey | l_linenumber | l_partkey | l_returnflag |' || chr(10) || '|---|---|---|---|' || chr(10) || "
    "string_agg('| ' || l_orderkey || ' | ' || l_linenumber || ' | ' || l_partkey || ' | ' || coalesce(l_returnflag, '') || ' |', chr(10) ORDER BY n) AS content "
    "FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_returnflag) - 1 AS n FROM lineitem) GROUP BY block",
)
def row_blocks(t: Tables):
    """Rows of one order share their key, which blocks by key range could not divide."""
    return tb.row_blocks(t.lineitem, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"])


@query("w3_balanced_numbers", "SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderdate, o_orderkey) - 1 AS no FROM orders")
def balanced_numbers(t: Tables):
    return balanced(t.orders.select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey", "o_orderdate", "o_orderkey"], "no", 10_000).select("o_orderkey", "no")


@query(
    "p5_record_text",
    "SELECT c_custkey, 'c_custkey: ' || c_custkey || chr(10) || 'c_name: ' || c_name || chr(10) || 'c_mktsegment: ' || coalesce(nullif(c_mktsegment, 'BUILDING'), 'None') AS content FROM customer",
)
def record_text(t: Tables):
    rows = t.customer.withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return rows.select("c_custkey", tb.record_text(["c_custkey", "c_name", "c_mktsegment"]).alias("content"))


@query(
    "p4_like_any_column",
    "SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE "
    + " OR ".join(f"contains(lower({c}), '{x}')" for c in ["p_name", "p_brand", "p_type"] for x in ["widget", "brand#12"]),
)
def like_any_column(t: Tables):
    rows = t.part.select("p_partkey", "p_name", "p_brand", "p_type")
    return tb.like_any(rows, ["p_name", "p_brand", "p_type"], ["widget", "Brand#12"], limit=None)
