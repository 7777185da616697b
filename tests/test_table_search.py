"""Table search against a plain version, over several tables at once."""

import re

import pytest

from corpusloom import lexicon
from corpusloom.functions import kernels
from corpusloom.operators import tables
from corpusloom.settings import Settings

ROWS = [
    (-4, "Quality lead", "x-ray 100%", "alpha"), (1, "quality Quality", None, "beta x-ray"), (2, "", "lead\nqual", None), (10, "é 日本語", "%", "日本"),
    (3, None, None, None), (None, "quality", "lead", "alpha"), (7, "quality lead", "x-ray 100%", "alpha"), (7, "quality lead", "x-ray 100%", "alpha"),
]
ASKED = {
    1: (["quality", "LEAD"], []), 2: (["x-ray"], ["quality lead"]), 3: (["%"], []), 4: (["日本", "é", ""], []), 5: (["nowhere"], []), 6: ([], []),
    7: (["lead", "lead"], ["x-ray 100"]), 8: (None, None), 9: (["qual", "alp"], []), 10: (["ua"], []),
}


def asked(spark):
    return spark.createDataFrame([(q, t, p) for q, (t, p) in ASKED.items()], "question_id int, terms array<string>, phrases array<string>")


def both(spark):
    rows = spark.createDataFrame(ROWS, "k long, a string, b string, c string")
    other = spark.createDataFrame([("z9", "x-ray%"), ("z10", "quality"), (None, "lead")], "code string, t string")
    # the name column of the first table is none of its text columns
    return [tables.Searchable("one", rows, "k", ("a", "b"), "c", ("a", "c")), tables.Searchable("two", other, "code", ("t",))]


def stems_of(spark, terms):
    from pyspark.sql import functions as F

    from corpusloom.functions.words import stem

    made = spark.createDataFrame([(t,) for t in sorted(set(terms))], "t string").select("t", stem(F.col("t"), lexicon.STEM_SUFFIXES_TABLE).alias("s"))
    return {r.t: r.s for r in made.collect()}


def plain(spark, limit, routes=None):
    known = stems_of(spark, [t for terms, _ in ASKED.values() for t in terms or ()])
    out = []
    for table in both(spark):
        held = table.rows.collect()
        for q, (terms, phrases) in ASKED.items():
            if routes is not None and (q, table.label) not in routes:
                continue
            low, phrases = {t.lower() for t in terms or () if t}, {p.lower() for p in phrases or ()}
            stems = {known[t] for t in terms or () if len(known[t]) >= 2}
            ranked, parts = [], []
            for r in held:
                texts = [(r[c] or "").lower() for c in table.text_columns]
                key = (r[table.key] is not None, r[table.key])
                met = sum(p in x for p in phrases for x in texts)
                if table.name_column:
                    words = [w for c in table.index for w in re.findall(r"[\w+]+", (r[c] or "").lower())]
                    n = sum(any(w.startswith(s) for w in words) for s in stems)
                    if n:
                        ranked.append((-round(n / len(stems) + 50 * sum(t in (r[table.name_column] or "").lower() for t in low) + 20 * met, 6), key))
                points = sum(t in x for t in low for x in texts) + 10 * met
                if points:
                    parts.append((-float(points), key))
            for score, key in sorted(ranked or parts)[:limit]:
                out.append((q, table.label, None if key[1] is None else str(key[1]), -score))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([(r.question_id, r.table, r.row_id, r.score) for r in df.collect()], key=str)


@pytest.mark.parametrize("limit", [1, 3, 10])
def test_tables_equal_plain_version(spark, limit):
    assert rows_of(tables.search_tables(asked(spark), both(spark), None, limit)) == plain(spark, limit)


def test_routed_questions_search_their_tables_only(spark):
    routes = {(1, "one"), (2, "two"), (3, "one"), (3, "two")}
    given = spark.createDataFrame(sorted(routes) + [(3, "two")], "question_id int, table string")
    assert rows_of(tables.search_tables(asked(spark), both(spark), given, 10)) == plain(spark, 10, routes)


def test_slices_and_chunks_change_nothing(spark, monkeypatch):
    from pyspark.sql import functions as F

    want = plain(spark, 2)
    monkeypatch.setattr(kernels, "PAIRS_AT_ONCE", 1)  # sparse sums, one row at a time
    cut = Settings(pattern_bytes=300)
    slices, _ = tables._asked(asked(spark), None, cut)
    assert len(slices) > 2
    hits = tables._hits(asked(spark), both(spark), 2, True, True, None, cut)
    first = tables.best(hits, ["question_id", "table"], [F.asc("kind"), *tables._row_order()], 2)
    least = first.groupBy("question_id", "table").agg(F.min("kind").alias("kind"))
    assert rows_of(first.join(least, ["question_id", "table", "kind"])) == want


def test_empty_tables_and_questions(spark):
    none = [tables.Searchable(t.label, t.rows.limit(0), t.key, t.text_columns, t.name_column, t.indexed_columns) for t in both(spark)]
    assert tables.search_tables(asked(spark), none).count() == 0
    assert tables.search_tables(asked(spark).limit(0), both(spark)).count() == 0


def test_no_text_is_exchanged(spark):
    plan = tables.search_tables(asked(spark), both(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in plan
