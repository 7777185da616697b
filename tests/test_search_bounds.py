"""Table search over many questions and rows: what is held and looked at, against plain versions."""

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.functions import kernels
from corpusloom.operators import tables


@pytest.mark.parametrize("digits, at_once", [(None, 1 << 20), (None, 40), (3, 40), (3, 1)])
def test_pruned_sums_equal_all_sums(monkeypatch, digits, at_once):
    monkeypatch.setattr(kernels, "PAIRS_AT_ONCE", at_once)
    rng = np.random.default_rng(at_once)
    n, width, limit = 30, 25, 3
    weights = np.where(rng.random((n, width)) < 0.2, rng.integers(1, 4, (n, width)), 0)
    values = np.where(rng.random((400, width)) < rng.random(width) * 0.6, rng.integers(1, 3, (400, width)) if digits is None else rng.normal(1, 0.6, (400, width)), 0)
    q, p = np.nonzero(weights)
    search = kernels._Search(q, p, weights[q, p], n, width, limit, digits=digits)
    keys, got = rng.permutation(400), {}
    for rows in np.array_split(np.arange(400), 4):
        rows = rows[np.argsort(keys[rows])]
        row, pattern = np.nonzero(values[rows])
        for a, b, s in zip(*search.best(row, pattern, values[rows][row, pattern], keys[rows])):
            got.setdefault(a, []).append((-s, keys[rows][b]))
    sums = weights @ values.T if digits is None else np.round(weights @ values.T, digits)
    for i in range(n):
        want = sorted((-s, k) for s, k in zip(sums[i], keys) if s > 0)[:limit]
        assert [k for _, k in sorted(got.get(i, []))[:limit]] == [k for _, k in want]


def test_questions_with_equal_terms_are_one_set(spark):
    questions = spark.createDataFrame([(i, ["steel", "RING"][:: 1 if i % 2 else -1], []) for i in range(400)], "question_id long, terms array<string>, phrases array<string>")
    slices, owners = tables._asked(questions, None, tables.DEFAULTS)
    assert sum(x.value.num_rows for x in slices) == 1 and owners.count() == 400


def test_a_task_gives_out_few_of_the_rows_that_are_alike():
    from types import SimpleNamespace

    asked = pa.table({"set_id": [1], "terms": [["ring"]], "stems": pa.array([["ring"]], pa.list_(pa.string())), "phrases": pa.array([[]], pa.list_(pa.string()))})
    rows = [pa.RecordBatch.from_pydict({
        "t": pa.array([0] * 200, pa.int32()), "num": list(range(a, a + 200)), "row_id": [str(i) for i in range(a, a + 200)],
        "texts": [["a ring"]] * 200, "words": ["\x01a\x01ring"] * 200}) for a in range(0, 2000, 200)]
    out = pa.Table.from_batches(kernels.table_hits(SimpleNamespace(value=asked), [("x", 1, 0)], 3, True, True)(rows))
    assert out.column("num").to_pylist() == [0, 1, 2]


def test_all_words_of_many_questions(spark):
    rows = spark.createDataFrame([(i, f"w{i % 5} w{i % 3} common", None) for i in range(60)] + [(None, "w1 common", "w2")], "k long, a string, b string")
    table = tables.Searchable("t", rows, "k", ("a", "b"))
    asked = {1: ["common"], 2: ["w1", "w2", "common"], 3: ["w9"], 4: [], 5: ["w1", "w1", "w2", "common"], 6: None}
    questions = spark.createDataFrame(list(asked.items()), "question_id long, words array<string>")
    want = set()
    for q, words in asked.items():
        held = [r for r in rows.collect() if words and set(words) <= set(f"{r.a} {r.b or ''}".split())]
        keys = sorted((r.k is not None, len(str(r.k)), str(r.k)) for r in held)[:4]
        want |= {(q, k[2] if k[0] else None, "t", i) for i, k in enumerate(keys, 1)}
    assert {tuple(r) for r in tables.search_all_words(questions, [table], 4).collect()} == want


def test_trigram_points_of_a_question_in_two_rows_add_up(spark, tmp_path):
    from corpusloom.operators import trigrams

    table = tables.Searchable("t", spark.createDataFrame([(i, "a-b" if i % 2 else "a+b") for i in range(300)], "k long, a string"), "k", ("a",))
    questions = spark.createDataFrame([(1, ["a", "-"], []), (1, ["-"], ["a-b"]), *[(i, ["-"], None) for i in range(2, 200)]], "question_id long, terms array<string>, phrases array<string>")
    trigrams.save_tables([table], str(tmp_path / "g"))
    got = {}
    for r in trigrams.search_indexed(questions, str(tmp_path / "g"), 2).collect():
        got.setdefault(r.question_id, []).append((r.row_id, r.score))
    assert sorted(got[1]) == [("1", 13.0), ("3", 13.0)]
    assert all(sorted(got[i]) == [("1", 1.0), ("3", 1.0)] for i in range(2, 200))
