"""Joins and dedup against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup, jaccard_join, line_dedup, queries, repeats
from corpusloom.llm.textkernel import shingle_sets

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def corpus(seed=1, groups=12, copies=9):
    """Near and exact copies of different degrees, and odd texts."""
    rng = random.Random(seed)
    rare = [f"w{i}" for i in range(4000)]
    rows, base = [], None
    for g in range(groups):
        base = [rng.choice(rare) for _ in range(rng.choice([4, 5, 6, 9, 15, 40, 120]))]
        for c in range(copies):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(words) // 8)):
                words[rng.randrange(len(words))] = rng.choice(rare)
            text = " ".join(words)
            rows.append("\n".join(text[i : i + 90] for i in range(0, len(text), 90)) if c % 3 == 0 else text)
    rows += [None, "", " \n\t ", "one", "ONE", "one", "Ünï cödé Wörter sind hier", "a b c d", "a b c d e", "a b c d e f", " ".join(rng.choice(rare) for _ in range(9000))]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    return rows + [rows[0], rows[1], (None, "one"), (None, None)]


def shingles(text):
    words = WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def closed(sets, percent):
    """Smallest id reachable from each (id, set)."""
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [least.get(top(i), d) for i, (d, _) in enumerate(sets)]


def key(row):
    return tuple((x is None, str(x)) for x in row)


def test_shingle_sets_count_distinct_runs_of_five_words():
    import pyarrow as pa

    texts = [t for _, t in corpus()]
    assert [len(x) for x in shingle_sets(pa.array(texts))] == [len(shingles(t)) for t in texts]


def test_jaccard_components_equal_brute_force(documents):
    rows = corpus()
    sets = [(d, shingles(t)) for d, t in rows]
    want = [(d, len(s), c) for (d, s), c in zip(sets, closed(sets, 80))]
    got = [(r["id"], r["n"], r["component"]) for r in jaccard_join.jaccard_components(documents(rows)).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_jaccard_paths_for_hot_blocks(documents, monkeypatch):
    """With a limit of 2, nearly every shared block is hot and goes through the packets."""
    monkeypatch.setattr(jaccard_join, "PACKET", 4)
    monkeypatch.setattr(jaccard_join, "MEMBERS", 3)
    monkeypatch.setattr(jaccard_join.shared_signatures, "__defaults__", (2,))
    rows = corpus(seed=2, groups=5, copies=16)
    sets = [(d, shingles(t)) for d, t in rows]
    want = [(d, len(s), c) for (d, s), c in zip(sets, closed(sets, 80))]
    got = [(r["id"], r["n"], r["component"]) for r in jaccard_join.jaccard_components(documents(rows)).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_sketch_distance_never_exceeds_symmetric_difference():
    import numpy as np

    rng, bands = np.random.default_rng(0), jaccard_join.Bands(80)
    for n in (5, 30, 400):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[n // 9 :], rng.integers(0, 1 << 63, n // 9).astype(np.uint64))))
        band = bands.of(len(a))[0]
        distance = int(np.bitwise_count((bands.sketch(a, band) ^ bands.sketch(b, band)).view(np.uint64)).sum())
        assert distance <= len(np.setxor1d(a, b))


def test_exact_groups(documents):
    rows = corpus() + [(i, "same " * 500) for i in range(500, 540)]
    got = exact_dedup.exact_groups(documents(rows), carry={"sha": F.sha2(F.coalesce("text", F.lit("")), 256)}).collect()
    members = {}
    for d, t in rows:
        members.setdefault(t or "", []).append(d)
    best = {t: max((d for d in ds if d is not None), default=None) for t, ds in members.items()}
    want = [(d, best[t or ""], len(members[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows]
    assert sorted(((r["id"], r["keep_id"], r["group_size"], r["sha"]) for r in got), key=key) == sorted(want, key=key)
    assert sum(r["kept"] for r in got) == len(members)
    assert all(r["id"] == r["keep_id"] for r in got if r["kept"])


def removed(rows, length):
    ids = {}
    for d, t in rows:
        data = (t or "").encode()
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            ids[s] = min(ids.get(s, 1 << 63), 1 << 63 if d is None else d)
    for d, t in rows:
        data = (t or "").encode()
        flag = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if ids[data[i : i + length]] < (1 << 63 if d is None else d):
                flag[i : i + length] = b"\1" * length
        kept = bytes(x for x, f in zip(data, flag) if not f)
        yield d, len(data), sum(flag), len(re.findall(b"\1+", bytes(flag))), hashlib.sha256(kept).hexdigest()


def test_repeated_bytes_equal_brute_force(documents, monkeypatch):
    rows = corpus(seed=3) + [(900, "ab" * 300), (901, "ab" * 200 + "c"), (902, "x" * 49), (903, "x" * 49), (904, "é" * 80)]
    want = sorted(removed(rows, 50), key=key)
    for hot in (1000, 2):
        monkeypatch.setattr(repeats, "HOT", hot)
        got = repeats.kept_texts(repeats.repeated_bytes(documents(rows))).collect()
        assert sorted(map(tuple, got), key=key) == want


def test_repeat_groups_are_the_maximal_repeats():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(60)).encode() for _ in range(4)]
    places = {}
    for i, t in enumerate(texts):
        for a in range(len(t)):
            for b in range(a + 8, len(t) + 1):
                places.setdefault(t[a:b], []).append((i, a))
    edge = lambda t, a: t[a] if 0 <= a < len(t) else None
    want = []
    for s, at in places.items():
        before = {edge(texts[i], a - 1) for i, a in at}
        after = {edge(texts[i], a + len(s)) for i, a in at}
        ends = [edge(texts[i], a + len(s)) is None for i, a in at]
        begins = [a == 0 for _, a in at]
        if len(at) > 1 and (len(before) > 1 or sum(begins) > 1) and (len(after) > 1 or sum(ends) > 1):
            want.append((len(s), sorted(at)))
    assert sorted(repeats.repeat_groups(texts, 8)) == sorted(want)


def line_matches(rows, percent, least):
    lines = sorted({((d is not None, d or 0), i, frozenset(WORDS.findall(x.translate(LOWER)))) for d, t in rows for i, x in enumerate((t or "").split("\n"))}, key=lambda x: x[:2])
    lines = [x for x in lines if len(x[2]) >= least]
    gone = set()
    for i, (d, n, words) in enumerate(lines):
        if any((e, m) < (d, n) and 100 * len(words & other) >= percent * len(words | other) for e, m, other in lines[:i]):
            gone.add((d[1] if d[0] else None, n))
    return gone


@pytest.mark.parametrize("held, dense", [(10_000, 8), (2, 8), (10_000, 0)])
def test_lines_equal_brute_force(documents, monkeypatch, held, dense):
    monkeypatch.setattr(line_dedup, "HELD", held)
    monkeypatch.setattr(line_dedup, "DENSE", dense)
    rows = corpus(seed=5) + [(700, "the same line here\nTHE same line here\nother words stand now\n\nthe same line"), (701, None), (702, "a b\na b\na b c\n a  b c ")]
    want = line_matches(rows, 80, 3)
    got = line_dedup.without_similar_lines(documents(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        lines = (r["text"] or "").split("\n")
        mine = [i for i in range(len(lines)) if (r["doc_id"], i) in want]
        assert r["removed_lines"] == mine
        assert r["kept_text"] == (r["text"] if not mine else "\n".join(x for i, x in enumerate(lines) if i not in mine))


@pytest.mark.parametrize("dense", [8, 0])
def test_long_lines_meet_only_where_they_may_match(documents, monkeypatch, dense):
    """Lines of many words that share rare words but not enough others are no pairs to verify; similar ones are all found."""
    monkeypatch.setattr(line_dedup, "DENSE", dense)
    rng, seen, similar = random.Random(9), [], line_dedup.similar
    monkeypatch.setattr(line_dedup, "similar", lambda pairs, *rest: seen.append(pairs.count()) or similar(pairs, *rest))
    rows = []
    for i in range(60):
        size = rng.choice([220, 300, 700])
        words = [f"q{rng.randrange(5)}"] + [f"w{rng.randrange(4000)}" for _ in range(size)]
        rows.append((i, " ".join(words)))
        if i % 6 == 0:  # near copies: below, at and above the threshold, and of another width
            for j, n in enumerate([5, size // 10, size // 5]):
                rows.append((100 + 3 * i + j, " ".join(words[: size - n] + [f"x{i}y{k}" for k in range(n if j else 0)])))
    want = line_matches(rows, 80, 3)
    assert len(want) > 15
    got = {(r["doc_id"], i) for r in line_dedup.without_similar_lines(documents(rows)).collect() for i in r["removed_lines"]}
    assert got == want
    assert sum(seen) < 120


def test_empty_tables(documents):
    empty = documents([])
    assert jaccard_join.jaccard_components(empty).collect() == []
    assert exact_dedup.exact_groups(empty).collect() == []
    assert repeats.kept_texts(repeats.repeated_bytes(empty)).collect() == []
    assert line_dedup.without_similar_lines(empty).collect() == []


def test_queries_equal_brute_force_on_whole_tables(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    sets = [(d, shingles(t)) for d, t in rows]
    want = [(d, len(s), c) for (d, s), c in zip(sets, closed(sets, 80))]
    assert sorted(map(tuple, queries.QUERIES["op1_jaccard_join"](spark, folder).collect())) == sorted(want)
    assert sorted(map(tuple, queries.QUERIES["op5_repeats"](spark, folder).collect())) == sorted(removed(rows, 50))
    gone = line_matches(rows, 80, 3)
    for r in queries.QUERIES["op3_line_dedup"](spark, folder).collect():
        lines = (dict(rows)[r["doc_id"]] or "").split("\n")
        mine = [i for i in range(len(lines)) if (r["doc_id"], i) in gone]
        kept = "\n".join(x for i, x in enumerate(lines) if i not in mine)
        assert tuple(r) == (r["doc_id"], len(lines), len(mine), ",".join(map(str, mine)), hashlib.sha256(kept.encode()).hexdigest())
