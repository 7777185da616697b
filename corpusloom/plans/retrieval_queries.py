"""Registered queries: lexical, dense and fused retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.operators import centroids, dense, fuse, lexical
from corpusloom.operators.sizing import best, shared_folder
from corpusloom.plans import sqltext as s
from corpusloom.plans.inputs import benchmark_questions, document_chunks, with_hashed
from corpusloom.plans.registry import Tables, query
from corpusloom.settings import DEFAULTS

K = DEFAULTS.top_k
POOL = fuse.lexical_pool(K)


@query(
    "r4_lexical_index",
    f"WITH {s.DOCS_BY_LANG}, {s.ASKED}, {s.lexical()} "
    "SELECT collection, term, df, round(weight, 6) AS weight FROM weights",
)
def lexical_index(t: Tables):
    tokens = lexical.tokenised(document_chunks(t, by_language=True))
    return lexical.term_weights(lexical.term_documents(tokens)).select(
        "collection", "term", "df", F.round("weight", 6).alias("weight")
    )


@query(
    "r4_postings",
    f"WITH {s.DOCS}, {s.ASKED}, {s.lexical()} SELECT chunk_id, term, tf, n_tokens FROM tf",
)
def lexical_postings(t: Tables):
    return lexical.postings(lexical.tokenised(document_chunks(t))).select("chunk_id", "term", "tf", "n_tokens")


@query(
    "r5_bm25_topk",
    f"WITH {s.DOCS}, {s.ASKED}, {s.lexical()} "
    + s.best("bm", "question_id", "score DESC, chunk_id", K, cols="question_id, chunk_id, score, rank"),
)
def bm25_topk(t: Tables):
    return lexical.bm25_top(benchmark_questions(t), document_chunks(t), K).drop("collection")


VEC_DIST = """
qs AS (SELECT vec_id AS question_id, label, embedding::DOUBLE[] AS e FROM embeddings),
vs AS (SELECT vec_id AS chunk_id, label AS collection, embedding::DOUBLE[] AS e FROM embeddings),
dist AS (SELECT question_id, collection, chunk_id, round(greatest(list_inner_product(q.e, q.e)
   + list_inner_product(v.e, v.e) - 2 * list_inner_product(q.e, v.e), 0), 9) AS distance FROM qs q, vs v)"""


def _vector_frames(t: Tables, collection):
    vectors = t.embeddings.select(
        collection.alias("collection"), F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec")
    )
    return t.embeddings.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vec")), vectors


@query(
    "r1_dense_topk",
    f"WITH {VEC_DIST}, ranked AS ({s.best('dist', 'question_id', 'distance, chunk_id', K)}) "
    "SELECT question_id, chunk_id, rank, round(1 / (1 + distance), 4) AS score FROM ranked WHERE 1 / (1 + distance) >= 0.2",
)
def dense_topk(t: Tables):
    questions, vectors = _vector_frames(t, F.lit("all"))
    return dense.retrieve(questions, vectors, K).select("question_id", "chunk_id", "rank", "score")


@query(
    "r1_dense_topk_strict",
    f"WITH {VEC_DIST}, ranked AS ({s.best('dist', 'question_id', 'distance, chunk_id', 5)}) "
    "SELECT question_id, chunk_id, rank, round(1 / (1 + distance), 4) AS score FROM ranked WHERE 1 / (1 + distance) >= 0.3",
)
def dense_topk_strict(t: Tables):
    questions, vectors = _vector_frames(t, F.lit("all"))
    return dense.retrieve(questions, vectors, 5, 0.3).select("question_id", "chunk_id", "rank", "score")


@query(
    "r1_dense_pruned",
    f"WITH {VEC_DIST}, ranked AS ({s.best('dist', 'question_id', 'distance, chunk_id', K)}) "
    "SELECT question_id, chunk_id, rank, round(1 / (1 + distance), 4) AS score FROM ranked WHERE 1 / (1 + distance) >= 0.2",
)
def dense_pruned(t: Tables):
    """The same hits from vectors stored by centroid."""
    questions, vectors = _vector_frames(t, F.lit("all"))
    place = f"{shared_folder(t.spark).rstrip('/')}/vectors-{uuid.uuid4().hex}"
    centroids.save_vectors(vectors, place, block_rows=64)
    return centroids.retrieve_pruned(questions, place, K, DEFAULTS.similarity_threshold).select("question_id", "chunk_id", "rank", "score")


@query(
    "r2_dense_pruned",
    f"WITH {VEC_DIST}, inner_k AS ({s.best('dist', 'question_id, collection', 'distance, chunk_id', 5, 'r0')}), "
    f"outer_k AS ({s.best('inner_k', 'question_id', 'distance, collection, chunk_id', 5)}) "
    "SELECT question_id, collection, chunk_id, rank, round(1 / (1 + distance), 4) AS score FROM outer_k",
)
def dense_per_collection_pruned(t: Tables):
    questions, vectors = _vector_frames(t, F.col("label"))
    place = f"{shared_folder(t.spark).rstrip('/')}/vectors-{uuid.uuid4().hex}"
    centroids.save_vectors(vectors, place, block_rows=64)
    hits = dense.across_collections(centroids.nearest_pruned(questions, place, 5).hits, 5)
    return hits.select("question_id", "collection", "chunk_id", "rank", F.round(dense.similarity(F.col("distance")), 4).alias("score"))


@query(
    "r2_dense_per_collection",
    f"WITH {VEC_DIST}, inner_k AS ({s.best('dist', 'question_id, collection', 'distance, chunk_id', 5, 'r0')}), "
    f"outer_k AS ({s.best('inner_k', 'question_id', 'distance, collection, chunk_id', 5)}) "
    "SELECT question_id, collection, chunk_id, rank, round(1 / (1 + distance), 4) AS score FROM outer_k",
)
def dense_per_collection(t: Tables):
    questions, vectors = _vector_frames(t, F.col("label"))
    hits = dense.across_collections(dense.nearest(questions, vectors, 5), 5)
    return hits.select(
        "question_id", "collection", "chunk_id", "rank",
        F.round(dense.similarity(F.col("distance")), 4).alias("score"),
    )


@query(
    "r3_relevance_scores",
    f"WITH {VEC_DIST}, ranked AS ({s.best('dist', 'question_id', 'distance, chunk_id', 5)}) "
    "SELECT question_id, chunk_id, rank, round(1 - distance / sqrt(2), 6) AS score FROM ranked",
)
def relevance_scores(t: Tables):
    questions, vectors = _vector_frames(t, F.lit("all"))
    return dense.nearest(questions, vectors, 5).select(
        "question_id", "chunk_id", "rank", F.round(dense.relevance(F.col("distance")), 6).alias("score")
    )


@query(
    "x2_hashed_vectors",
    f"WITH {s.DOCS}, {s.vectors('cv', 'chunks', 'chunk_id')} SELECT chunk_id, b, round(v, 6) AS v FROM cv",
)
def hashed_vectors(t: Tables):
    vectors = with_hashed(document_chunks(t)).select("chunk_id", F.posexplode("vec").alias("b", "v"))
    return vectors.filter(F.col("v") != 0).select(
        "chunk_id", "b", F.round(F.col("v").cast("double"), 6).alias("v")
    )


def fused_documents(t: Tables, k: int = K, by_language: bool = False):
    chunks, questions = document_chunks(t, by_language), benchmark_questions(t)
    near = dense.nearest(with_hashed(questions), with_hashed(chunks), k).withColumn(
        "similarity", dense.similarity(F.col("distance"))
    )
    words = lexical.bm25_top(questions, chunks, fuse.lexical_pool(k))
    return fuse.fuse(near, words, chunks, k)


@query(
    "r6_rank_fusion",
    f"WITH {s.DOCS}, {s.ASKED}, {s.lexical()}, {s.distances()}, {s.fused(K, POOL)} "
    "SELECT question_id, place, chunk_id, source, shown, fused FROM fused",
)
def rank_fusion(t: Tables):
    return fused_documents(t).drop("collection")


@query(
    "r8_lexical_slot",
    f"WITH {s.DOCS_BY_LANG}, {s.ASKED}, {s.lexical()}, {s.distances()}, {s.fused(2, fuse.lexical_pool(2))} "
    "SELECT question_id, collection, place, chunk_id, source, shown FROM fused WHERE shown > 0.05",
)
def lexical_slot(t: Tables):
    hits = fused_documents(t, 2, by_language=True)
    return hits.filter(F.col("shown") > DEFAULTS.fused_threshold).drop("fused")
