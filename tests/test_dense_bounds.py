"""Dense search: what a task holds and what is exchanged stays bounded, with the same hits."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from corpusloom.functions import kernels
from corpusloom.operators import centroids, dense

NAMES = ["question_id", "collection", "chunk_id", "distance", "rank"]


def rows_of(df):
    return sorted(tuple(r[n] for n in NAMES) for r in df.collect())


def scattered(spark, n=600, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([("ab"[i % 2], i, [float(x) for x in np.float32(rng.normal(size=dim))]) for i in range(n)], "collection string, chunk_id long, vec array<float>").repartition(3)


def test_pairs_of_questions_and_blocks_are_no_rows(spark, tmp_path, monkeypatch):
    vectors = scattered(spark)  # without clusters most blocks are in reach
    questions = vectors.select(vectors.chunk_id.alias("question_id"), "vec")
    place = str(tmp_path / "v")
    centroids.save_vectors(vectors, place, n_centroids=6, block_rows=8)
    visits, met = [], centroids._met

    def counted(stored, asked, wanted, *rest):
        visits.append(wanted.count())
        return met(stored, asked, wanted, *rest)

    monkeypatch.setattr(centroids, "_met", counted)
    monkeypatch.setattr(centroids, "ASKED_BYTES", 20_000)
    found = centroids.nearest_pruned(questions, place, 3, 8)
    assert rows_of(found.hits) == rows_of(dense.nearest(questions, vectors, 3, 8))
    assert sum(visits) <= 600 * 2 * 3 < found.read.count()


def test_questions_that_come_twice(spark, tmp_path):
    vectors = scattered(spark, 60)
    one = vectors.select(vectors.chunk_id.alias("question_id"), "vec").filter("question_id < 9")
    twice = one.unionByName(one).unionByName(one.filter("question_id = 1").selectExpr("question_id + 100 AS question_id", "vec"))
    centroids.save_vectors(vectors, str(tmp_path / "v"), n_centroids=3, block_rows=4)
    want = rows_of(dense.nearest(one, vectors, 4, 8))
    got = rows_of(dense.nearest(twice, vectors, 8, 8))
    assert [r[:4] for r in got if r[0] < 100] == sorted([r[:4] for r in want] * 2)
    assert rows_of(centroids.nearest_pruned(twice, str(tmp_path / "v"), 8, 8).hits) == got


def test_a_task_gives_out_k_rows_per_question(monkeypatch):
    rng = np.random.default_rng(1)
    q, m = rng.normal(size=(50, 4)).astype(np.float32), rng.normal(size=(900, 4)).astype(np.float32)
    held = SimpleNamespace(value=[(np.arange(a, a + 25).tobytes(), q[a : a + 25].tobytes()) for a in (0, 25)])
    batches = [pa.RecordBatch.from_pydict({"key": ["x"] * 300, "id": np.arange(a, a + 300), "vec": list(m[a : a + 300])}) for a in (600, 0, 300)]
    whole = pa.Table.from_batches(kernels.nearest_to_held(held, 5, "key", 4)(batches))
    assert whole.num_rows == 50 * 5
    dist = ((q[:, None, :].astype(float) - m[None, :, :]) ** 2).sum(2)
    got = {}
    for r in sorted(whole.to_pylist(), key=lambda r: r["distance"]):
        got.setdefault(r["question_id"], []).append(r["chunk_id"])
    assert all(got[i] == list(np.argsort(dist[i], kind="stable")[:5]) for i in range(50))
