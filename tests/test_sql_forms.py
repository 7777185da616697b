"""Registered queries against their SQL forms on the smallest tables.  tools/check_sql.py runs all of them."""

import glob
import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "a1_answered_aggregates", "c2_timestamps", "c4_messages", "c9_conversation_summary", "c10_message_windows", "c11_keywords",
    "e5_hit_metrics", "e8_text_metrics", "e13_score_rows_lexical", "j1_sessions_with_counts", "j2_parents_with_children",
    "j5_orphans", "q1_intent", "q3_source_weights", "q5_table_routing", "q6_entities", "q7_expanded_documents", "q8_expanded_terms",
    "q10_phrases", "q12_resolved_aggregates", "r1_dense_topk", "r4_lexical_index", "r5_bm25_topk", "r6_rank_fusion", "r13_substring_search", "r13_multiword_search",
    "r16_merged_results", "r20_value_conflicts", "r22_context", "s7_table_blocks", "s9_clean_export", "s13_folder_items",
    "s14_folder_tree", "s15_urls", "s16_file_names", "s17_persisted_index", "t2_clean_context", "t6_snippet", "t8_degenerate",
    "t1_chunk_words", "u3_upserted", "w3_renumbered",
]


def norm(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else f"{type(v).__name__}:{v}"


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    got = table(df.columns, df.collect())
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == table(columns, want.fetchall())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sql_forms_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
