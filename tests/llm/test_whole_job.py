"""Whole results where a shortcut would lose some: links, long words and paragraphs, large groups."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import jaccard_join, lang_crf, licenses, repeats
from tests.llm.test_similarity import corpus, key, removed, shingles


@pytest.mark.parametrize("packet", [256, 3])
def test_links_equal_brute_force(documents, monkeypatch, packet):
    """Near copies are all linked with each other, not only with the first of them."""
    monkeypatch.setattr(jaccard_join, "PACKET", packet)
    rng = random.Random(6)
    base = [f"v{i}" for i in range(200)]
    rows = corpus(seed=6, groups=6, copies=7)
    for i in range(12):
        words = list(base)
        words[rng.randrange(200)] = f"x{i}"
        rows.append((800 + i, " ".join(words)))
    sets = [(d, shingles(t)) for d, t in rows]
    like = lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
    want = [(d, sum(like(s, o) for j, (_, o) in enumerate(sets) if j != i)) for i, (d, s) in enumerate(sets)]
    got = [(r["id"], r["n_links"]) for r in jaccard_join.jaccard_components(documents(rows), count_links=True).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(n for d, n in got if d is not None and d >= 800) >= 12 * 11


def test_all_links_give_every_pair_of_sets(documents):
    rows = [(i, " ".join(f"y{j if j != i else -i - 1}" for j in range(100))) for i in range(9)] + [(20, "y1 y2 y3"), (21, None)]
    docs = documents(rows).select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("key"))
    _, nodes, linked = jaccard_join.links(docs.select("id", "text"))
    pairs = jaccard_join.all_links(docs, nodes, jaccard_join.components(linked))
    name = {r["node"]: r["id"] for r in nodes.collect()}
    want = {frozenset((a, b)) for a, t in rows for b, u in rows if a < b and (x := shingles(t)) and (y := shingles(u)) and 100 * len(x & y) >= 80 * len(x | y)}
    got = [frozenset((name[r["a"]], name[r["b"]])) for r in pairs.collect()]
    assert len(want) == 36 and len(got) == 36 and set(got) == want


def test_large_groups_are_read_in_bounded_blocks(documents, monkeypatch):
    """One common string with differing surroundings, and a long text that leads a group: no suffix array over a whole group."""
    rng = random.Random(7)
    noise = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    base = noise(3000)
    rows = [(i, noise(40) + "-" * 30 + "common words" + noise(20) + "\n" + "-" * 80) for i in range(40)]
    rows += [(100 + i, base[a : a + 900] + noise(60)) for i, a in enumerate(range(0, 2000, 100))] + [(90, base), (None, base[:200]), (100, base[:400])]
    want = sorted(removed(rows, 50), key=key)
    sizes, whole = [], repeats.suffix_array
    for hot, largest in ((2, 4 << 20), (1000, 2000)):
        monkeypatch.setattr(repeats, "HOT", hot)
        monkeypatch.setattr(repeats, "LARGEST", largest)
        monkeypatch.setattr(repeats, "BLOCK", min(largest, 1 << 20))
        got = repeats.kept_texts(repeats.repeated_bytes(documents(rows))).collect()
        assert sorted(map(tuple, got), key=key) == want
    held = [(i, i, 0, t.encode()) for i, t in rows[:40]]
    monkeypatch.setattr(repeats, "suffix_array", lambda data, depth: sizes.append(len(data)) or whole(data, depth))
    assert len(repeats.removed_spans(held, 50, 0)) > len(repeats.removed_spans(held, 50))


def test_long_words_are_read_to_the_end():
    assert lang_crf.zlib.crc32(b"gqx") % lang_crf.FEATURES in lang_crf.features_of("b" * 60 + "qx" + "c" * 20)


def test_text_without_blanks_is_cut_into_words():
    import numpy as np

    text = "".join(chr(0x4E00 + i) for i in range(200))
    data = np.frombuffer(f"ab {text} cd".encode(), np.uint8)
    starts, ends, hashes, first = lang_crf.words_of(data, np.array([0, len(data)]))
    assert len(starts) == 52 and first.tolist() == [0, 52] and len(hashes) == 52
    words = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert words[1] == text[:5] and words[2] == text[4:9] and words[50] == text[196:] and words[51] == "cd"


def test_lexicon_keeps_words_of_a_small_language(spark):
    known = spark.createDataFrame([("big word " * 500, "aa"), ("tiny few", "bb")], "text string, lang string")
    names, shares = lang_crf.lexicon(known, ["aa", "bb"], 10)
    assert len(names) == 4 and (shares[:, 1] > 0).sum() == 2


def test_notice_within_a_long_paragraph(documents):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeflmnorst") for _ in range(6))
    filler = [(100 + i, " ".join(word() for _ in range(30))) for i in range(60)]
    known = " ".join(t for _, t in filler).split()
    long = lambda *notices: "  ".join(" ".join(rng.choice(known) for _ in range(500)) + " " + n for n in (*notices, ""))
    rows = [(1, "head\n" + long("Released under the MIT License.")), (2, long("licensed under the GNU Lesser General Public License")), (3, long("")),
            (4, long("Licensed under the Apache License, Version 2.0.", "released under the ISC license"))]
    got = {r["id"]: [(x["line"], x["family"]) for x in r["found"]] for r in licenses.licenses(documents(rows + filler)).collect()}
    assert (got[1], got[2], got[3]) == ([(1, "MIT")], [(0, "LGPL")], [])
    assert sorted(got[4]) == [(0, "Apache"), (0, "ISC")]
