"""Retrieval operators against plain twins on small inputs."""

import math
import random
import re
from collections import Counter, defaultdict

from corpusloom.operators import dense, fuse, lexical
from corpusloom.operators.ordering import numbered, running_sum
from corpusloom.settings import Settings
from pyspark.sql import functions as F

TEXTS = {
    1: "red fox jumps over the lazy dog", 2: "the dog sleeps", 3: "red wine and red cheese", 4: "the the the", 5: "a fox and a dog and a cat",
}


def bm25(texts, question):
    toks = {k: re.findall(r"\w+", v.lower()) for k, v in texts.items()}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(t for ts in toks.values() for t in set(ts))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    out = {}
    for k, ts in toks.items():
        tf = Counter(ts)
        out[k] = sum(idf.get(w, 0) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ts) / avg)) for w in re.findall(r"\w+", question.lower()))
    return out


def test_bm25_equals_plain(spark):
    chunks = spark.createDataFrame([("c", k, v) for k, v in TEXTS.items()], "collection string, chunk_id long, text string")
    asked = {10: "red fox", 11: "the dog dog", 12: "nothing matches"}
    questions = spark.createDataFrame(list(asked.items()), "question_id long, text string")
    got = {(r.question_id, r.chunk_id): r.score for r in lexical.bm25_scores(questions, chunks).collect()}
    want = {(q, k): round(v, 6) for q, text in asked.items() for k, v in bm25(TEXTS, text).items() if v > 0}
    assert got == want


def test_collections_have_their_own_statistics(spark):
    rows = [("a", 1, "red fox"), ("a", 2, "dog"), ("b", 3, "red dog"), ("b", 4, "red cat"), ("b", 5, "cow")]
    chunks = spark.createDataFrame(rows, "collection string, chunk_id long, text string")
    questions = spark.createDataFrame([(1, "red")], "question_id long, text string")
    got = {(r.collection, r.chunk_id): r.score for r in lexical.bm25_scores(questions, chunks).collect()}
    for c in "ab":
        part = {k: t for n, k, t in rows if n == c}
        assert {k: v for (n, k), v in got.items() if n == c} == {k: round(v, 6) for k, v in bm25(part, "red").items() if v > 0}


def test_nearest_equals_plain(spark):
    rng = random.Random(1)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(8)]
    chunks = [("a" if i % 3 else "b", i, vec()) for i in range(60)]
    questions = [(i, vec()) for i in range(5)]
    c = spark.createDataFrame(chunks, "collection string, chunk_id long, vec array<float>").repartition(5)
    q = spark.createDataFrame(questions, "question_id long, vec array<float>")

    got = defaultdict(list)
    for r in dense.nearest(q, c, 4, 8, Settings(question_block=2, broadcast_bytes=100)).orderBy("rank").collect():
        got[r.question_id, r.collection].append(r.chunk_id)
    for qid, x in questions:
        for name in "ab":
            order = sorted((sum((a - b) ** 2 for a, b in zip(x, v)), k) for n, k, v in chunks if n == name)
            assert got[qid, name] == [k for _, k in order[:4]]


def plain_fusion(near, words, source, prefix, k):
    scores, shown, seen = {}, {}, []
    floor = max(min((s for _, s in near), default=0.1), 0.1)
    for items in (near, [(d, floor) for d in words]):
        for rank, (d, s) in enumerate(items, 1):
            key = prefix[d]
            if key not in scores:
                scores[key], shown[key] = 0.0, (d, s)
                seen.append(key)
            scores[key] += 1 / (60 + rank)
    order = sorted(seen, key=lambda x: -scores[x])
    picked, extra, used = [], [], Counter()
    for key in order:
        src = source[shown[key][0]]
        if used[src] < 2:
            picked.append(key)
            used[src] += 1
        else:
            extra.append(key)
        if len(picked) >= k:
            break
    picked += extra[: k - len(picked)]
    if words and k > 1 and prefix[words[0]] not in picked:
        picked = picked[: k - 1] + [prefix[words[0]]]
    return [shown[x][0] for x in picked]


def test_fusion_equals_plain(spark):
    rng = random.Random(5)
    docs = {i: (f"text {i % 17}", f"s{i % 3}") for i in range(20)}  # some texts are copies, but other chunks
    chunks = spark.createDataFrame([("c", i, t, s) for i, (t, s) in docs.items()], "collection string, chunk_id long, text string, source string")
    near_rows, word_rows, want = [], [], {}
    for q in range(25):
        k = 4
        near = [(d, round(1 - 0.1 * n, 3)) for n, d in enumerate(rng.sample(range(20), k))]
        words = rng.sample(range(20), 8)
        near_rows += [(q, "c", d, n, s) for n, (d, s) in enumerate(near, 1)]
        word_rows += [(q, "c", d, n) for n, d in enumerate(words, 1)]
        want[q] = plain_fusion(near, words, {i: s for i, (_, s) in docs.items()}, {i: i for i in docs}, k)
    near_df = spark.createDataFrame(near_rows, "question_id long, collection string, chunk_id long, rank int, similarity double")
    word_df = spark.createDataFrame(word_rows, "question_id long, collection string, chunk_id long, rank int")
    got = defaultdict(list)
    for r in fuse.fuse(near_df, word_df, chunks, 4).orderBy("question_id", "place").collect():
        got[r.question_id].append(r.chunk_id)
    assert dict(got) == want


def test_running_sum_crosses_blocks(spark):
    rows = [("hot", i, i % 3 == 0) for i in range(1, 500)] + [("cold", i, True) for i in range(5)]
    df = spark.createDataFrame(rows, "file string, line_no long, head boolean")
    got = {(r.file, r.line_no): r.n for r in running_sum(df, ["file"], "line_no", F.col("head").cast("int"), "n", block=7).collect()}
    total = Counter()
    for file, line, head in sorted(rows):
        total[file] += head
        assert got[file, line] == total[file]
    assert sorted(r.n for r in numbered(df, ["file"], "line_no", "n", block=10).filter("file = 'hot'").collect()) == list(range(1, 500))


def test_chunks_with_a_common_header_stay_apart(spark):
    head = "header " * 60
    chunks = spark.createDataFrame([("c", 1, head + "red fox", "s1"), ("c", 2, head + "red dog", "s2")], "collection string, chunk_id long, text string, source string")
    near = spark.createDataFrame([(7, "c", 1, 1, 0.9), (7, "c", 2, 2, 0.8)], "question_id long, collection string, chunk_id long, rank int, similarity double")
    words = spark.createDataFrame([(7, "c", 2, 1)], "question_id long, collection string, chunk_id long, rank int")
    assert {r.chunk_id for r in fuse.fuse(near, words, chunks, 5).collect()} == {1, 2}


def test_shuffled_sides_give_the_same_scores(spark):
    chunks = spark.createDataFrame([("c", k, v) for k, v in TEXTS.items()], "collection string, chunk_id long, text string")
    questions = spark.createDataFrame([(10, "red fox"), (11, "the dog dog")], "question_id long, text string")
    plain = lexical.bm25_scores(questions, chunks)
    none = lexical.bm25_scores(questions, chunks, Settings(broadcast_bytes=0))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, none.collect()))
