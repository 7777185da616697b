"""Work that is done inside the row, or once, so that its memory and time do not grow with batches and branches."""

import numpy as np
from pyspark.sql import functions as F

from corpusloom.functions import kernels
from corpusloom.functions.vectors import hashed_buckets, hashed_vector
from corpusloom.operators import merge, search
from corpusloom.settings import Settings


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hashed_vectors_are_made_without_python(spark):
    texts = ["satu dua dua tiga", "Öl, naïve 価格 x_1", "", "..", "a " * 500 + "b", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    made = df.select("id", hashed_vector(F.col("text"), 8).alias("vec"), hashed_buckets(F.col("text"), 8).alias("buckets"))
    assert "Python" not in plan_of(made)
    for row in made.collect():
        counts = np.bincount(np.array(row.buckets or [], np.int64), minlength=8).astype(float)
        norm = np.sqrt((counts * counts).sum())
        assert row.vec == list((counts / norm if norm else counts).astype(np.float32)), texts[row.id]


def test_batches_are_cut_by_their_entries():
    import pyarrow as pa

    lists = [["x"] * n for n in (3, 0, 2, 9, 1, 1, 4, 0)] + [None]
    batch = pa.RecordBatch.from_pydict({"n": list(range(9)), "terms": pa.array(lists, pa.list_(pa.string()))}).slice(1)
    cut = list(kernels._by_entries([batch, batch.slice(0, 0)], "terms", 5))
    assert [x for b in cut for x in b.column("n").to_pylist()] == list(range(1, 9))
    assert all(b.num_rows == 1 or sum(len(x or []) for x in b.column("terms").to_pylist()) <= 5 for b in cut)


def test_stated_values_read_the_results_once(spark):
    rows = [
        (1, 1, "pdf", "a", 0.9, "Rp 500 dan 600 Project Manager: Ani Lee"), (1, 2, "pdf", "b", 0.8, "harga 500"), (1, 3, "chat", "c", 0.7, "Project Manager: Budi"),
        (2, 1, "pdf", "a", 0.5, "7"), (2, 2, "pdf", "a", 0.5, None), (3, 1, None, "a", 0.5, "8 9"), (None, 1, "pdf", "a", 0.5, "8 9"),
    ]
    df = spark.createDataFrame(rows, "question_id long, rank int, type string, source string, confidence double, content string")
    found = merge.value_conflicts(df)
    assert plan_of(found).count("Generate ") == 1
    got = {(r.question_id, r.entity, r.value): (r.n, r.sources, r.n_values, r.wins) for r in found.collect()}
    assert got == {
        (1, "price_pdf", "500"): (2, ["a", "b"], 2, True), (1, "price_pdf", "600"): (1, ["a"], 2, False),
        (1, "role_project_manager", "Ani Lee"): (1, ["a"], 2, True), (1, "role_project_manager", "Budi"): (1, ["c"], 2, False),
    }


def test_saved_words_are_not_joined_by_shuffle(spark):
    chunks = spark.createDataFrame([("c", i, f"harga motor {i}", "s") for i in range(9)], "collection string, chunk_id long, text string, source string")
    questions = spark.createDataFrame([(1, "harga motor 3"), (2, "stok")], "question_id long, text string")
    words = spark.createDataFrame([("c", "harga"), ("c", "motor")], "collection string, word string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = search.search_chats(questions, chunks, words, 2)
        lines = [x for x in plan_of(found).splitlines() if "SortMergeJoin [collection" in x]
        assert all("chunk_id" in x for x in lines) and len(found.collect()) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_texts_of_chats_are_not_dealt_by_question(spark):
    chunks = spark.createDataFrame([(f"c{i % 4}", i, f"Harga motor {i}", "s") for i in range(40)], "collection string, chunk_id long, text string, source string").repartition(7)
    questions = spark.createDataFrame([(1, "harga motor 3"), (2, "stok motor 12")], "question_id long, text string")
    words = spark.createDataFrame([("c0", "harga"), ("c0", "motor")], "collection string, word string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = search.search_chats(questions, chunks, words, 2, Settings(broadcast_bytes=0))
        told = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
        dealt = [x for x in told.split("\n\n") if ") Exchange" in x and "hashpartitioning(question_id" in x]
        assert dealt and not any("text#" in x or "low#" in x for x in dealt)
        rows = sorted(map(str, found.collect()))
        assert rows and rows == sorted(map(str, search.search_chats(questions, chunks, words, 2).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    vectors = search.by_collection(search.hashed(chunks, 8))
    held = vectors.select(F.spark_partition_id().alias("p"), "collection").distinct().groupBy("p").count()
    assert vectors.count() == 40 and max(r["count"] for r in held.collect()) <= 2


def test_near_vectors_equal_all_distances():
    rng = np.random.default_rng(5)
    for scale, dim in ((1.0, 16), (1e-3, 3), (1e4, 8)):
        q, m = (np.round(rng.random((n, dim)), 2) * scale for n in (50, 200))
        m[150:], q[:10] = m[:50], m[:10]
        every = kernels._nearest(q, m, 3)[2]
        far = np.sort(every, axis=1)[:, 2]
        row, col, dist = kernels._near(q, m, 3, far)
        assert np.all(np.abs(dist - every[row, col]) <= 2e-9)
        want = {(i, j) for i, j in zip(*np.nonzero(every < (far - 1e-8)[:, None]))}
        assert want <= {*zip(row, col)} and np.all(every[row, col] <= far[row] + 2e-8)
