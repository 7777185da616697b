"""Lexical search, hard negatives and packing by neighbours against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom.llm import hard_negatives, lexical_search, retrieval_packing

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# packing by neighbours ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokens():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def checked_pieces(pieces, rows, tokens, capacity):
    """Every id lies in one piece, sequences have no gaps and need no padding; gives the documents of each sequence."""
    whole = Counter()
    ids = {d: tokens(t) for d, t in rows}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    times = Counter(d for d, _ in rows)
    for d, some in by_doc.items():
        whole[d] = sum(p["length"] for p in some)
        assert whole[d] == times[d] * len(ids[d])
        for p in some:
            part = ids[d][p["start"] : p["start"] + p["length"]]
            assert len(part) == p["length"] > 0 and p["doc_tokens"] == len(ids[d])
            assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        assert sorted(Counter((p["start"]) for p in some if times[d] == 1).values(), reverse=True)[:1] in ([], [1])
    assert set(by_doc) == {d for d, _ in rows}
    for some in by_sequence.values():
        at = 0
        for p in sorted(some, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == capacity or at & (at - 1) == 0
    return [{p["doc_id"] for p in some} for some in by_sequence.values()]


def packing_rows(seed=1):
    rng = random.Random(seed)
    topics = [[f"{t}{rng.choice('bdgk')}{i}ing" for i in range(40)] for t in ("astro", "bread", "canoe")]
    rows = [(i, " ".join(rng.choice(topics[i % 3]) for _ in range(rng.randrange(5, 60)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\n\t x"), (103, "word " * 900), (104, "a" * 5000), (105, "naïve 日本語 <|endoftext|> don't   stop\n "), (None, "no id"), (-3, "no id")]
    return rows + [(106, "same text twice")] * 2


@pytest.mark.parametrize("sizes", [{}, {"task_tokens": 900}, {"shard_docs": 7}, {"shard_tokens": 300, "task_tokens": 2000}])
def test_packing_round_trip(documents, tokens, sizes):
    rows = packing_rows()
    got = retrieval_packing.packed_with_neighbours(documents(rows), capacity=128, **sizes).collect()
    checked_pieces(got, rows, tokens, 128)


def test_windows_hold_related_documents(documents, tokens):
    rows = [(d, t) for d, t in packing_rows(2) if d is not None and 0 <= d < 60]
    got = retrieval_packing.packed_with_neighbours(documents(rows), capacity=512).collect()
    mixed = [s for s in checked_pieces(got, rows, tokens, 512) if len(s) > 1]
    pure = [s for s in mixed if len({d % 3 for d in s}) == 1]
    assert len(mixed) >= 5 and len(pure) >= len(mixed) / 2


def test_packing_query_on_the_whole_table(spark, tokens):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = entry.queries()["op11_retrieval_packing"](spark, folder).collect()
    held = checked_pieces(got, rows, tokens, 2048)
    total = sum(len(tokens(t)) for _, t in rows)
    assert len(held) <= total / 2048 + 12


def test_packing_of_an_empty_table(documents):
    assert retrieval_packing.packed_with_neighbours(documents([]), capacity=64).collect() == []


# lexical search ----------------------------------------------------------------------------------


def cut(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k):
    terms = [(d, cut(t)) for d, t in docs]
    terms = [(d, w) for d, w in terms if w]
    n_docs, n_terms = len(terms), sum(len(w) for _, w in terms)
    df = Counter(t for _, w in terms for t in set(w))
    asked = {}
    for item, text in set(items):
        asked.setdefault(item, Counter()).update(cut(text))
    out = []
    for item, counts in asked.items():
        scores = []
        for d, w in terms:
            tf, m = Counter(w), 75 + 25 * len(w) * n_docs // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m)) for t, times in counts.items() if tf[t])
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def search_rows(seed):
    rng = random.Random(seed)
    words = ["the", "of", "Of", "É1", "été", "x_y", "9a", *(f"w{i}" for i in range(30))]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for i in range(80)]
    docs += [(200, None), (201, ""), (202, "--- !"), (203, "the " * 3000), (204, "w1,w2"), (204, "w1,w2"), (None, "w1 w2"), (5, "w3 w4 the")]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 25)))) for i in range(25)]
    items += [(50, None), (51, " ! "), (52, "nowhere"), (53, items[0][1]), (53, items[0][1]), (54, "w1 w1 w2"), (54, "the"), (None, "w5 of")]
    return docs, items


@pytest.mark.parametrize("slice_terms", [200_000, 60])
@pytest.mark.parametrize("seed", [1, 2])
def test_search_equals_brute_force(spark, documents, seed, slice_terms):
    docs, items = search_rows(seed)
    asked = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, item string, rank int")
    got = lexical_search.ranked_documents(documents(docs), asked, k=5, slice_terms=slice_terms).collect()
    assert sorted(((r["item"], r["rank"], r["doc"], r["score"]) for r in got), key=str) == ranked(docs, items, 5)


def test_search_of_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.ranked_documents(documents([(1, "a b")]), none).collect() == []
    assert lexical_search.ranked_documents(documents([]), one).collect() == []
    assert lexical_search.ranked_documents(documents([(1, "")]), one).collect() == []


def test_shared_sets_are_added_up_once():
    rng = random.Random(3)
    terms = [b"t%d" % i for i in range(50)]
    common = [(t, 1) for t in terms[:12]]
    items = [sorted(set(common + [(t, rng.choice([1, 1, 2])) for t in rng.sample(terms[12:], 6)])) for _ in range(40)] + [[(terms[0], 3)]]
    sharing = lexical_search.shared_sets(items)
    of_term = np.random.default_rng(3).integers(0, 1000, (len(sharing.terms), 9))
    code = {t: i for i, t in enumerate(sharing.terms)}
    want = np.array([sum(n * of_term[code[t]] for t, n in row) for row in items])
    assert (lexical_search.item_scores(sharing, of_term) == want).all()
    plain = sum(len(row) - 1 for row in items)
    assert len(sharing.pairs) + sum(len(row) - 1 for row in sharing.items) < plain / 2


# hard negatives ----------------------------------------------------------------------------------


def mined(rows, every=100):
    rows = [(v, l, [math.floor(256 * float(x)) for x in e]) for v, l, e in rows
            if v is not None and l is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for v, l, e in {(v, l, tuple(e)) for v, l, e in rows if v % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(e, f)), w, m) for w, m, f in rows if w != v)
        for s, w, _ in [x for x in scored if x[2] == l][:5]:
            far = [x for x in scored if x[2] != l and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(v, w, r, x[1], -s, -x[0]) for r, x in enumerate(far, 1)]
    return sorted(out)


def vector_rows(seed, dim=6):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(4, dim))
    rows = [(int(i), int(rng.integers(3)), [float(x) for x in np.float32(centers[rng.integers(4)] + rng.normal(size=dim) * rng.choice([0, 0.05, 0.5]))]) for i in range(300)]
    rows += [(300, None, [1.0] * dim), (400, 1, None), (500, 1, [None] + [1.0] * (dim - 1)), (600, 1, [float("nan")] * dim), (700, 2, [float("inf")] * dim),
             (None, 1, [0.5] * dim), (800, 1, []), (900, 1, [0.5, 0.25]), (1000, 7, [1.0] * dim), (1, 1, rows[1][2]), (100, rows[100][1], rows[100][2]), (-100, 0, [-1.0] * dim)]
    return rows


def vectors(spark, rows):
    schema = "vec_id bigint, label int, embedding array<float>, `block` string, `nth` string, `rank` string, `_salt` string"
    return spark.createDataFrame([(*r, *["x"] * 4) for r in rows], schema).repartition(3)


@pytest.mark.parametrize("every,tree,slice_bytes", [(100, 512, 1 << 25), (10, 4, 1 << 25), (10, 8, 1), (1, 16, 20_000)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, every, tree, slice_bytes):
    monkeypatch.setattr(hard_negatives, "TREE", tree)
    monkeypatch.setattr(hard_negatives, "CHUNK", 50)
    rows = vector_rows(every)
    got = hard_negatives.hard_negatives(vectors(spark, rows), every=every, slice_bytes=slice_bytes).collect()
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r[n] for n in names) for r in got) == mined(rows, every)


def test_hard_negatives_without_anchors(spark):
    assert hard_negatives.hard_negatives(vectors(spark, [])).collect() == []
    assert hard_negatives.hard_negatives(vectors(spark, [(1, 1, [1.0]), (2, 1, [1.0])])).collect() == []
    assert hard_negatives.hard_negatives(vectors(spark, [(100, 1, [1.0])])).collect() == []


def test_relabelled(spark):
    got = hard_negatives.with_relabelled(vectors(spark, [(7, 9, [1.0]), (14, None, [1.0]), (8, 9, [1.0])])).orderBy("vec_id").collect()
    assert [(r["vec_id"], r["label"]) for r in got] == [(7, 0), (8, 9), (14, None)]


def test_tree_bounds_leave_pairs_out():
    """Anchors near each other: most candidates outside the window are never scored."""
    rng = np.random.default_rng(5)
    center = rng.normal(size=32)
    anchors = np.floor(256 * (center + 0.01 * rng.normal(size=(200, 32))))
    parents, edges = hard_negatives.spanning_tree(anchors)
    tree = hard_negatives.Tree({"block": 0, "label": 0, "n": 200, "ids": np.arange(200).tobytes(), "vectors": anchors.tobytes(), "parents": parents.tobytes(), "edges": edges.tobytes()})
    found = np.floor(256 * rng.normal(size=(3000, 32)))
    whole = anchors @ found.T
    low = np.full(200, np.sort(whole[0])[-30])
    scores = tree.scores(found, low, np.full(200, np.inf))
    assert ((scores == whole) | (scores < hard_negatives.LOW / 2)).all() and (scores[whole >= low[:, None]] > 0).all()
    assert tree.scored < tree.pairs / 4


def test_large_values_are_exact(spark):
    big = float(2**20 + 1)
    rows = [(i, i % 2, [big, float(i), -big]) for i in range(0, 40)]
    rows[0] = (0, 0, [big, big, 1.0])
    got = hard_negatives.hard_negatives(vectors(spark, rows)).select(F.sum("negative_score"), F.count("*")).first()
    want = mined(rows)
    assert tuple(got) == (sum(r[5] for r in want) or None, len(want))
