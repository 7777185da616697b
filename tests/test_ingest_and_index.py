"""Chats in parts, balanced numbers, block-max postings, pruned vector search and the trigram index."""

import os
import random
import shutil

from pyspark.sql import functions as F

from corpusloom.operators import blockmax, chat, lexical, ordering, tables
from corpusloom.streaming import chats

LINES = [
    "lost before any message", "[2024-01-05 08:00:00] Ana: one", "goes on", "", "03/04/2024, 10:15 - Budi: two", "Ana created group x",
    "and on", "and on", "and still", "12/31/24, 9:05 PM - Ana: three", "99/99/2024, 10:15 - Ana: no date", "last line",
    "[2024-01-06 08:00:00] Cid: four", "[2024-01-06 08:00:01] Cid: five",
]


def parts_of(lines, size):
    return ["\n".join(lines[i : i + size]) for i in range(0, len(lines), size)]


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write(text)


def whole(spark, logs):
    lines = chat.lines_of(spark.createDataFrame([(k, "\n".join(v)) for k, v in logs.items()], "file string, text string"))
    return sorted(map(tuple, chat.messages(lines).collect()))


def test_chat_in_parts_equals_the_whole_chat(spark, tmp_path):
    src, table, mark = (str(tmp_path / n) for n in ("in", "table", "mark"))
    logs = {"a.txt": LINES, "b/c.txt": LINES[3:], "d.txt": LINES[2:3] * 3, "e.txt": LINES[1:2]}

    def run():
        for q in chats.ingest_chats(chats.arriving_parts(spark, src), table, mark):
            q.awaitTermination()
        rows = [tuple(r) for r in chats.streamed_messages(spark, table).collect()]
        assert len(rows) == len(set(rows))
        return sorted(rows)

    parts = {name: parts_of(lines, 3) for name, lines in logs.items()}

    def arrive(name, k):
        stem, end = name.rsplit(".", 1)
        put(os.path.dirname(f"{src}/{stem}"), os.path.basename(f"{stem}__p{k}.{end}"), parts[name][k])

    seen = {"a.txt": 2, "b/c.txt": 1, "d.txt": 1}
    for name, n in seen.items():
        for k in range(n):
            arrive(name, k)
    arrive("b/c.txt", 2)  # waits for part 1
    assert run() == whole(spark, {n: "\n".join(parts[n][:k]).split("\n") for n, k in seen.items()})
    arrive("a.txt", 3)
    assert run() == whole(spark, {n: "\n".join(parts[n][:k]).split("\n") for n, k in seen.items()})
    for name, made in parts.items():
        for k in range(len(made)):
            if not os.path.exists(f"{src}/{name.rsplit('.', 1)[0]}__p{k}.txt"):
                arrive(name, k)
    want = whole(spark, logs)
    assert run() == want
    # a crash before the last batches were confirmed: they are run again from the state before them
    for name in ("inner", "borders"):
        last = max((f for f in os.listdir(f"{mark}/{name}/commits") if f.isdigit()), key=int)
        for f in (last, f".{last}.crc"):
            if os.path.exists(f"{mark}/{name}/commits/{f}"):
                os.remove(f"{mark}/{name}/commits/{f}")
    assert run() == want
    # a part that comes again under another name is not taken again
    put(f"{src}/again", "x", "")
    shutil.copy(f"{src}/a__p1.txt", f"{src}/a__p01.txt")
    assert [r for r in run() if r[0] != "again/x"] == want


def test_only_border_messages_go_through_the_state(spark):
    parts = spark.createDataFrame([("c", 0, "\n".join(LINES))], "chat string, part long, text string")
    folded = chats.folded_parts(parts)
    assert chats._inner(folded).count() == len(whole(spark, {"c": LINES})) - 1
    plan = folded._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_balanced_numbers(spark):
    rng = random.Random(1)
    keys = [rng.choice([5, 5, 5, rng.randrange(1 << 60)]) for _ in range(5000)] + [None] * 40
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, v long").repartition(7)
    made = ordering.balanced(df, ["k"], "n", rows_per_part=500).collect()
    assert sorted(r.n for r in made) == list(range(len(keys)))
    in_order = [r.k for r in sorted(made, key=lambda r: r.n)]
    assert in_order == sorted(keys, key=lambda k: (k is not None, k))
    assert ordering.balanced(df.limit(0), ["k"], "n").count() == 0


def test_ranges_of_repeated_keys_are_even(spark):
    df = spark.range(20_000).select(F.lit(7).alias("k"))
    numbers = ordering.balanced(df, ["k"], "n", rows_per_part=1000)
    assert numbers.agg(F.min("n"), F.max("n"), F.countDistinct("n")).first() == (0, 19_999, 20_000)
    placed = df.withColumn("p", F.monotonically_increasing_id()).repartitionByRange(20, "k", "p")
    sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_row_blocks_are_exact(spark):
    rows = spark.createDataFrame([(1, "a|b"), (1, "c"), (1, None), (900, "d\ne"), (10**12, "f")], "k long, v string")
    got = tables.row_blocks(rows, "t", ["k", "v"], ["k", "v"], 2).orderBy("block").collect()
    assert [r.content.split("\n")[4:] for r in got] == [["| 1 |  |", "| 1 | a\\|b |"], ["| 1 | c |", "| 900 | d e |"], ["| 1000000000000 | f |"]]


def topics(spark, n=600, seed=2):
    """Chunks whose neighbours speak of the same things."""
    rng = random.Random(seed)
    rows = [("x" if i % 3 else "y", i, " ".join(rng.choice([f"t{i // 60}w{rng.randrange(9)}", f"c{rng.randrange(40)}", "the"]) for _ in range(rng.randrange(1, 40)))) for i in range(n)]
    questions = [(q, f"the t{q % 10}w1 t{q % 10}w2 t{q % 10}w2 c{q}") for q in range(20)] + [(98, "nothing here"), (99, "")]
    return spark.createDataFrame(rows, "collection string, chunk_id long, text string"), spark.createDataFrame(questions, "question_id long, text string")


def test_block_max_reads_fewer_blocks(spark, tmp_path):
    chunks, questions = topics(spark)
    place = str(tmp_path / "blocks")
    blockmax.save_blocks(chunks, place, 16)
    found = blockmax.block_max_top(questions, place, 4)
    names = ["question_id", "collection", "chunk_id", "score", "rank"]
    got = sorted(tuple(r[n] for n in names) for r in found.hits.collect())
    want = sorted(tuple(r[n] for n in names) for r in lexical.bm25_top(questions, chunks, 4).collect())
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert all(abs(a[3] - b[3]) <= 1e-6 for a, b in zip(got, want))
    visits = found.visits.agg(F.count("*"), F.sum(F.col("read").cast("int"))).first()
    assert visits[1] < 0.5 * visits[0]
    only = blockmax.block_max_top(questions, place, 4, ["y"]).hits.collect()
    assert sorted(tuple(r[n] for n in names) for r in only) == [r for r in got if r[1] == "y"]


def test_block_max_writes_no_pairs_of_questions_and_blocks(spark, tmp_path, monkeypatch):
    chunks, questions = topics(spark)
    place = str(tmp_path / "blocks")
    blockmax.save_blocks(chunks, place, 4)
    written, cut = [], blockmax.cut_lineage

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(blockmax, "cut_lineage", counted)
    found = blockmax.block_max_top(questions, place, 4)
    # 22 questions with up to 4 blocks or chunks in each of two collections; each of 20 has a word of all 150 blocks
    assert max(written) <= 22 * 2 * 4
    assert found.hits.count() <= 22 * 2 * 4
    assert found.visits.count() > 20 * 100


def test_block_max_bounds_hold_no_postings(spark, tmp_path):
    chunks, questions = topics(spark, 60)
    blockmax.save_blocks(chunks, str(tmp_path / "b"))
    held = spark.read.parquet(str(tmp_path / "b/bounds"))
    assert set(held.columns) == {"collection", "term", "block", "bound"}
    assert spark.read.parquet(str(tmp_path / "b/blocks")).agg(F.max(F.size("held"))).first()[0] <= blockmax.BLOCK_CHUNKS


def clustered(spark, n=1500, dim=8, seed=3):
    import numpy as np

    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dim)) * 4
    rows = [("abc"[i % 3], i, [float(x) for x in np.float32(centers[i % 12] + rng.normal(size=dim) * 0.2)]) for i in range(n)]
    rows += [("a", n + i, rows[0][2]) for i in range(200)] + [("few", 9000 + i, rows[i][2]) for i in range(3)]
    asked = [(i, [float(x) for x in np.float32(centers[i % 12] + rng.normal(size=dim) * 0.3)]) for i in range(30)] + [(90, rows[0][2]), (91, [0.0] * dim)]
    return (spark.createDataFrame(rows, "collection string, chunk_id long, vec array<float>").repartition(3),
            spark.createDataFrame(asked, "question_id long, vec array<float>"))


def test_pruned_vectors_equal_the_whole_search(spark, tmp_path, monkeypatch):
    from corpusloom.operators import centroids, dense

    vectors, asked = clustered(spark)
    names = ["question_id", "collection", "chunk_id", "distance", "rank"]
    want = sorted(tuple(r[n] for n in names) for r in dense.nearest(asked, vectors, 5, 8).collect())
    place = str(tmp_path / "v")
    centroids.save_vectors(vectors, place, n_centroids=24, block_rows=16)
    blocks = spark.read.parquet(f"{place}/rings").count()
    for rings in (200_000, 40):
        monkeypatch.setattr(centroids, "RINGS", rings)
        found = centroids.nearest_pruned(asked, place, 5, 8)
        assert sorted(tuple(r[n] for n in names) for r in found.hits.collect()) == want
        assert found.read.count() < 0.35 * blocks * 32
        assert found.read.count() == found.read.distinct().count()


def test_one_centroid_holds_most_vectors(spark, tmp_path):
    from corpusloom.operators import centroids, dense

    vectors = spark.createDataFrame([("a", i, [1.0, 0.0]) for i in range(900)] + [("a", 900 + i, [0.0, float(i)]) for i in range(9)], "collection string, chunk_id long, vec array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 4.2])], "question_id long, vec array<float>")
    centroids.save_vectors(vectors, str(tmp_path / "v"), n_centroids=4, block_rows=50)
    rings = spark.read.parquet(str(tmp_path / "v/rings"))
    assert rings.agg(F.max("n")).first()[0] <= 50
    got = sorted(map(tuple, centroids.nearest_pruned(asked, str(tmp_path / "v"), 7, 2).hits.select("question_id", "chunk_id", "distance", "rank").collect()))
    assert got == sorted(map(tuple, dense.nearest(asked, vectors, 7, 2).select("question_id", "chunk_id", "distance", "rank").collect()))


def signs(spark):
    rows = spark.createDataFrame(
        [(1, "100% cotton", "x-ray Ab"), (2, "cotton", "XRAY a"), (3, "%", None), (4, "a b", "é 日本語"), (5, "", "x-ra"), (10, "cotton cotton 5 %", "q")], "k long, a string, b string")
    other = spark.createDataFrame([("z9", "x-ray%")], "code string, t string")
    return [tables.Searchable("one", rows, "k", ("a", "b"), "a"), tables.Searchable("two", other, "code", ("t",))]


def test_trigram_search_finds_terms_of_any_kind(spark, tmp_path):
    from corpusloom.operators import trigrams

    found = signs(spark)
    asked = {1: (["%"], []), 2: (["X-Ray"], ["cotton"]), 3: (["q"], []), 4: (["ab", "a"], []), 5: (["日本語", "本", "é"], []), 6: (["on 5"], []), 7: (["nowhere", ""], []), 8: ([], [])}
    questions = spark.createDataFrame([(q, t, p) for q, (t, p) in asked.items()], "question_id long, terms array<string>, phrases array<string>")
    for block in (2, 1024):
        place = str(tmp_path / f"grams{block}")
        trigrams.save_tables(found, place, block)
        got = {tuple(r) for r in trigrams.search_indexed(questions, place, 10, block).collect()}
        want = set()
        for t in found:
            for r in t.rows.collect():
                for q, (terms, phrases) in asked.items():
                    low = [(r[c] or "").lower() for c in t.text_columns]
                    score = sum(x in c for c in low for x in {y.lower() for y in terms} if x) + 10 * sum(p in c for c in low for p in phrases)
                    if score:
                        want.add((q, t.label, str(r[t.key]), float(score)))
        assert got == want


def test_word_search_finds_terms_of_signs(spark):
    questions = spark.createDataFrame([(1, ["%"], []), (2, ["% c"], []), (3, ["-"], []), (4, ["x-ray"], [])], "question_id long, terms array<string>, phrases array<string>")
    got = {(r.question_id, r.row_id, r.score) for r in tables.search_parts(questions, signs(spark)[0]).collect()}
    assert got == {(1, "1", 1.0), (1, "3", 1.0), (1, "10", 1.0), (2, "1", 1.0), (3, "1", 1.0), (3, "5", 1.0), (4, "1", 1.0)}


def test_dictionary_table_equals_chained_replacements(spark):
    from corpusloom.operators import patterns

    names = {"ana maria": "A", "maria lopez silva": "B", "lopez silva": "C", "li": "D", "jo (x)": "E"}
    texts = ["Ana Maria Lopez Silva met Li", "ANA MARIA, ana maria; LOPEZ SILVA", "é ana mariaana maria", "", None, "jo (x) jo x", "maria lopez silva maria lopez silvana maria"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    table = spark.createDataFrame(list(names.items()) + [(None, "n"), ("", "e")], "name string, alias string")
    want = {r.i: (r.t, r.a) for r in df.select("i", chat.masked(F.col("t"), names).alias("t"), chat.pseudonym(F.col("t"), names).alias("a")).collect()}
    for size in (64 << 20, 150):  # in one slice and in several
        settings = patterns.DEFAULTS.__class__(broadcast_bytes=size)
        got = patterns.masked_by(patterns.pseudonym_by(df, "t", table, "a", settings=settings), "t", table, settings)
        assert {r.i: (r.t, r.a) for r in got.collect()} == want


def test_ten_thousand_names_are_one_plan(spark):
    from corpusloom.operators import patterns

    names = spark.range(10_000).select(F.concat(F.lit("name "), F.col("id").cast("string"), F.lit("!")).alias("name"), F.col("id").cast("string").alias("alias"))
    df = spark.range(200).select("id", F.concat(F.lit("by Name "), (F.col("id") * 7).cast("string"), F.lit("! and name 5!")).alias("t"))
    got = patterns.masked_by(df, "t", names)
    assert {(r.id, r.t) for r in got.collect()} == {(i, f"by {7 * i} and 5") for i in range(200)}
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_segments_equal_a_fresh_index(spark, tmp_path):
    from corpusloom.sources import segments

    place = str(tmp_path / "index")
    chunks, questions = topics(spark, 120)
    rows = {(r.collection, r.chunk_id): r.text for r in chunks.collect()}
    kind = "collection string, chunk_id long, text string"
    frame = lambda d: spark.createDataFrame([(*k, t) for k, t in d.items()], kind)
    names = ["question_id", "collection", "chunk_id", "score", "rank"]

    def same(live):
        got = sorted(tuple(r[n] for n in names) for r in segments.search_segments(questions, place, 3).collect())
        want = sorted(tuple(r[n] for n in names) for r in lexical.bm25_top(questions, frame(live), 3).collect())
        assert got == want

    keys = sorted(rows)
    one, two = {k: rows[k] for k in keys[:50]}, {k: rows[k] for k in keys[50:]} | {("x", 5000): "", ("y", 5001): "- -"}
    segments.add_segment(spark, place, frame(one))
    segments.add_segment(spark, place, frame(two))
    same(one | two)
    new = {keys[3]: "t1w1 the the", keys[60]: "", ("z", 1): "the t2w1"}
    out = [keys[10], keys[70], ("x", 5000), ("nowhere", 1)]
    segments.add_segment(spark, place, frame(new), spark.createDataFrame(out, "collection string, chunk_id long"))
    live = {k: t for k, t in (one | two | new).items() if k not in out}
    same(live)
    before = {f: os.path.getmtime(f"{place}/segments/1/{f}") for f in os.listdir(f"{place}/segments/1")}
    segments.compact(spark, place, 2, 3)
    same(live)
    assert before == {f: os.path.getmtime(f"{place}/segments/1/{f}") for f in os.listdir(f"{place}/segments/1")}
    segments.add_segment(spark, place, None, spark.createDataFrame(keys[:1], "collection string, chunk_id long"))
    live.pop(keys[0])
    segments.compact(spark, place, 1, 9)
    same(live)
    files = sorted(os.listdir(f"{place}/segments"))
    segments.drop_collection(spark, place, "y")
    live = {k: t for k, t in live.items() if k[0] != "y"}
    same(live)
    assert sorted(os.listdir(f"{place}/segments")) == files
    os.makedirs(f"{place}/segments/77")  # a run that failed before its manifest
    segments.add_segment(spark, place, frame({("y", 1): "the t1w1", ("y", 2): "cow"}))
    same(live | {("y", 1): "the t1w1", ("y", 2): "cow"})


def test_segments_hold_a_row_for_each_chunk(spark, tmp_path):
    from corpusloom.sources import segments

    place, kind = str(tmp_path / "index"), "collection string, chunk_id long, text string"
    rows = [("x", 1, "a b a c"), ("x", 2, "b b d"), ("x", 2, "b b d"), ("x", 3, ""), ("x", 4, None), ("y", 1, "e")] + [("x", i, f"w{i}") for i in range(10, 20)]
    segments.add_segment(spark, place, spark.createDataFrame(rows, kind))
    assert spark.read.parquet(f"{place}/segments/1/postings").count() == 15  # a chunk without text is none, one without words is
    segments.add_segment(spark, place, spark.createDataFrame([("x", 1, "d d f")], kind), spark.createDataFrame([("y", 1)], "collection string, chunk_id long"))
    assert spark.read.parquet(f"{place}/segments/2/postings").count() == 1
    # a chunk that comes twice is one hit
    asked = spark.createDataFrame([(7, "f b"), (8, "a e")], "question_id long, text string")
    assert sorted((r.question_id, r.chunk_id) for r in segments.search_segments(asked, place, 3).collect()) == [(7, 1), (7, 2)]


def test_common_subsequence_equals_the_table():
    import time

    from corpusloom.functions import kernels

    def table(x, y):
        row = [0] * (len(x) + 1)
        for t in y:
            new = [0]
            for i, u in enumerate(x):
                new.append(row[i] + 1 if t == u else max(row[i + 1], new[i]))
            row = new
        return row[-1]

    rng = random.Random(4)
    for _ in range(60):
        x, y = ([rng.randrange(rng.choice([2, 9, 60])) for _ in range(rng.randrange(0, 150))] for _ in "ab")
        assert kernels.common_subsequence(x, y) == table(x, y)
    x, y = ([rng.randrange(900) for _ in range(5000)] for _ in "ab")
    start = time.perf_counter()
    assert kernels.common_subsequence(x, x) == 5000 and 0 < kernels.common_subsequence(x, y) < 5000
    assert time.perf_counter() - start < 2


def test_dense_search_in_several_slices(spark):
    from corpusloom.operators import dense
    from corpusloom.settings import Settings

    vectors, asked = clustered(spark, 300)
    want = sorted(map(tuple, dense.nearest(asked, vectors, 4, 8).collect()))
    few = Settings(question_block=4, broadcast_bytes=8 * 4 * 40)
    assert sorted(map(tuple, dense.nearest(asked, vectors, 4, 8, few).collect())) == want
    assert len(want) == 32 * (4 * 3 + 3)


def test_words_are_counted_inside_the_row(spark):
    df = spark.createDataFrame([("a", 1, "b a b ab A"), ("a", 2, ""), ("a", 3, None), ("b", 1, "x")], "collection string, chunk_id long, text string")
    tokens = lexical.tokenised(df)
    assert sorted((r.collection, r.chunk_id, r.term, r.tf) for r in lexical.postings(tokens).collect()) == [
        ("a", 1, "a", 2), ("a", 1, "ab", 1), ("a", 1, "b", 2), ("b", 1, "x", 1)]
    assert "Exchange" not in lexical.postings(tokens)._jdf.queryExecution().executedPlan().toString()
