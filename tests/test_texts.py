"""Splitting and token metrics against plain twins."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from corpusloom import lexicon
from corpusloom.functions import chunking, kernels, text as tf
from corpusloom.functions.words import stem


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_token_overlap_equals_plain_table():
    rng = random.Random(7)
    pairs = [([rng.choice("abcdef") for _ in range(rng.randrange(0, 30))], [rng.choice("abcdef") for _ in range(rng.randrange(0, 30))]) for _ in range(200)]
    out = kernels.token_overlap([p[0] for p in pairs], [p[1] for p in pairs])
    for (a, b), n, c in zip(pairs, out["lcs"], out["clipped"]):
        assert n == lcs(a, b)
        assert c == (sum((Counter(a) & Counter(b)).values()))


def test_chunks_fit_and_cover():
    rng = random.Random(3)
    for size, overlap, ladder in [(50, 10, lexicon.SEPARATORS_DOCUMENT), (80, 0, lexicon.SEPARATORS_FRESH), (40, 20, lexicon.SEPARATORS_PAGE)]:
        for _ in range(60):
            parts = [f"w{i}" + rng.choice([" ", ", ", "\n", "\n\n", ". ", "! "]) for i in range(rng.randrange(1, 150))]
            text = "".join(parts)
            chunks = kernels.split_text(text, size, overlap, ladder)
            assert all(0 < len(c) <= size and c in text for c in chunks)
            starts = [text.index(c) for c in chunks]
            assert starts == sorted(starts)
            covered = set()
            for c in chunks:
                covered |= set(re.findall(r"w\d+", c))
            assert covered == set(re.findall(r"w\d+", text))
            if overlap == 0:
                assert sum(len(re.findall(r"w\d+", c)) for c in chunks) == len(parts)


def test_chunk_edges():
    ladder = lexicon.SEPARATORS_DOCUMENT
    assert kernels.split_text("", 10, 2, ladder) == []
    assert kernels.split_text("short", 10, 2, ladder) == ["short"]
    assert kernels.split_text("a" * 25, 10, 2, ladder) == ["a" * 10, "a" * 10, "a" * 9]
    assert kernels.split_text("one two three", 8, 4, ladder) == ["one two", "three"]
    assert kernels.split_text("aa bb cc dd", 6, 3, ladder) == ["aa bb", "bb cc", "cc dd"]


def test_chunks_of_passes_columns(spark):
    df = spark.createDataFrame([(1, "x", "para one\n\npara two"), (2, "y", "   ")], "doc_id long, source string, text string")
    rows = chunking.chunks_of(df, 10, 0).orderBy("doc_id", "chunk_i").collect()
    assert [(r.doc_id, r.source, r.chunk_i, r.text) for r in rows] == [(1, "x", 0, "para one"), (1, "x", 1, "para two")]


def test_stem_and_checks(spark):
    df = spark.createDataFrame([("makanan",), ("berlari",), ("di",), ("diambilkan",)], "w string")
    assert [r[0] for r in df.select(stem(F.col("w"))).collect()] == ["makan", "lar", "di", "ambil"]
    texts = ["short", "spam spam spam spam spam spam eggs", "this is a perfectly fine and readable answer", "strngth xkcdz bcdfg hjklm npqrs"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(tf.degenerate(F.col("t"))).collect()
    assert [r[0] for r in got] == [True, True, False, True]


def test_bleu_penalty(spark):
    from corpusloom.operators.metrics import text_metrics

    row = text_metrics(spark.createDataFrame([(1, "alpha beta", "alpha beta gamma delta")], "k int, hyp string, ref string"), ["k"]).first()
    assert row.bleu_1 == round(math.exp(1 - 4 / 2), 6) and row.rouge_l == round(2 * 1 * 0.5 / 1.5, 6)
