"""Chat parsing, sources, persisted collections, ingest and hooks on small files."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from corpusloom.operators import chat, upkeep
from corpusloom.plans import answering
from corpusloom.sources import folder, relations, store
from corpusloom.streaming import ingest

CHAT = """header line before any message
[2024-01-05 08:00:00] Ana: hello there
second line
03/04/2024, 10:15 - Budi: image attached
created group by someone
12/31/24, 9:05 PM - Ana: see you
04/03/98, 10:15 - Ana: old
99/99/2024, 10:15 - Ana: no date here
"""


def lines(spark, text, name="f"):
    return chat.lines_of(spark.createDataFrame([(name, text)], "file string, text string"))


def test_messages(spark):
    rows = chat.messages(lines(spark, CHAT)).orderBy("line_no").collect()
    assert [(r.message_id, r.sender, r.content) for r in rows] == [
        ("wa_2", "Ana", "hello there\nsecond line"), ("wa_4", "Budi", "image attached"), ("wa_6", "Ana", "see you"),
        ("wa_7", "Ana", "old\n99/99/2024, 10:15 - Ana: no date here"),
    ]
    assert [r.ts for r in rows] == [
        dt.datetime(2024, 1, 5, 8), dt.datetime(2024, 4, 3, 10, 15), dt.datetime(2024, 12, 31, 21, 5), dt.datetime(1998, 3, 4, 10, 15),
    ]


def test_window_tail(spark):
    rows = [("f", i, f"wa_{i}", "a", dt.datetime(2024, 1, 1), str(i)) for i in range(1, 5)]
    msgs = spark.createDataFrame(rows, "file string, line_no long, message_id string, sender string, ts timestamp, content string")
    got = chat.windows(msgs, 4, 1).orderBy("window").collect()
    assert [(r.start_index, r.end_index, r.message_count) for r in got] == [(0, 3, 4), (3, 3, 1)]


PASTED = """junk
short text... by Real Name
Real Name
7/27/2022 10:34 AM

first line
image second line

after the message
2 new notifications
other... by Someone Else
2/3/2025 7:12 PM
Unknown Person
direct text by nobody
not in a block
third... by Real Name
Real Name
no time here

lost
last... by Real Name
1/2/2024 1:05 AM
text without a blank line.
Begin quote, x
Ask real name more
"""


def test_pasted_chat(spark):
    got = chat.pasted_messages(lines(spark, PASTED), {"real name": "Dev_A"}).orderBy("line_no").collect()
    assert [(r.ts, r.sender, r.content) for r in got] == [
        (dt.datetime(2022, 7, 27, 10, 34), "Dev_A", "first line second line"),
        (dt.datetime(2024, 1, 2, 1, 5), "Dev_A", "text without a blank line. Ask Dev_A more"),
    ]


def write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_folder(spark, tmp_path):
    base = str(tmp_path / "corpus")
    write(f"{base}/a.txt", "café \xff ok ".encode("latin-1") + b"\xe2\x82")
    write(f"{base}/b.md", b"# title")
    write(f"{base}/deep/er/c.log", b"line")
    write(f"{base}/blank.txt", b"  \n ")
    write(f"{base}/Draft_x.txt", b"draft")
    write(f"{base}/d.bin", b"zz")
    write(f"{base}/e.json", json.dumps({"b": [1, 2], "a": "x"}).encode())
    write(f"{base}/p.pdf", b"page one|  |page  three")
    docs = {os.path.basename(r.source): (r.doc_type, r.text) for r in folder.text_documents(spark, base, exclude=["draft"]).collect()}
    assert docs == {"a.txt": ("txt", "caf  ok"), "b.md": ("markdown", "# title"), "c.log": ("log", "line")}
    flat = folder.text_documents(spark, base, max_depth=1)
    assert {os.path.basename(r.source) for r in flat.collect()} == {"a.txt", "b.md", "Draft_x.txt"}
    found = folder.eligible(folder.files(spark, base), base, (".pdf",))
    pages = folder.extracted_pages(found, lambda b: b.decode().split("|"))
    assert [(r.page, r.text) for r in pages.orderBy("page").collect()] == [(1, "page one"), (3, "page three")]
    merged = folder.merged_pages(pages, separator="\n").collect()
    assert [r.text for r in merged] == ["page one\npage three"]
    assert json.loads(folder.json_documents(spark, base).first().text) == {"b": [1, 2], "a": "x"}
    counts = {r.suffix: r.n_files for r in folder.inventory(folder.files(spark, base)).collect()}
    assert counts[".txt"] == 3 and counts[".pdf"] == 1


def test_chat_encodings(spark):
    raw = [b"plain", "﻿mark".encode(), "wide".encode("utf-16"), "café".encode("latin-1")]
    df = spark.createDataFrame([(bytearray(b),) for b in raw], "content binary")
    assert [r[0] for r in df.select(chat.decoded(F.col("content"))).collect()] == ["plain", "mark", "wide", "café"]


def test_source_specs():
    assert relations.source_kind("/data/x") == "folder"
    assert relations.source_kind("postgres://h/db") == "tables"
    assert relations.source_parts("/a | postgresql://h/db") == [("/a", "folder"), ("postgresql://h/db", "tables")]


def test_store_replaces_only_given_collections(spark, tmp_path):
    place = str(tmp_path / "store")
    one = spark.createDataFrame([("a", 1, "red fox"), ("b", 2, "blue fox"), ("b", 3, "cow"), ("b", 4, "hen")], "collection string, chunk_id long, text string")
    store.save_collections(one, place)
    two = spark.createDataFrame([("a", 9, "red red cat"), ("a", 10, "dog"), ("a", 11, "cow")], "collection string, chunk_id long, text string")
    store.save_collections(two, place)
    kept = {(r.collection, r.chunk_id) for r in store.load_collections(spark, place, "chunks").collect()}
    assert kept == {("a", 9), ("a", 10), ("a", 11), ("b", 2), ("b", 3), ("b", 4)}
    questions = spark.createDataFrame([(1, "red fox")], "question_id long, text string")
    best = {(r.collection, r.chunk_id) for r in store.score_saved(questions, place, 1).collect()}
    assert best == {("a", 9), ("b", 2)}
    store.drop_collections(spark, place, str(tmp_path / "next"), ["a"])
    assert {r.collection for r in store.load_collections(spark, str(tmp_path / "next"), "chunks").collect()} == {"b"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "question_id long, answer string")
    store.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().answer == "x"
    rows = spark.createDataFrame([("s", 2, "two"), ("s", -4, "head"), ("s", 10, "ten")], "source string, seq long, line string")
    store.write_lines(rows, str(tmp_path / "txt"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "txt/source=s")).collect()) == ["head", "ten", "two"]


def test_ingest_takes_changes(spark, tmp_path):
    src, table, mark = (str(tmp_path / n) for n in ("in", "chunks", "mark"))

    def run():
        ingest.ingest(ingest.arriving(spark, src), table, mark).awaitTermination()
        return {(r.source, r.text) for r in ingest.current(spark, table).collect()}

    write(f"{src}/one.txt", b"first text")
    write(f"{src}/two.txt", b"stays")
    write(f"{src}/a/readme.txt", b"in a")
    write(f"{src}/b/readme.txt", b"in b")
    write(f"{src}/b/readme.md", b"marked down")
    write(f"{src}/x__v1.txt", b"old x")
    write(f"{src}/x__v2.txt", b"new x")
    others = {("two.txt", "stays"), ("a/readme.txt", "in a"), ("b/readme.txt", "in b"), ("b/readme.md", "marked down"), ("x.txt", "new x")}
    assert run() == {("one.txt", "first text")} | others
    write(f"{src}/one__v2.txt", b"changed text")
    assert run() == {("one.txt", "changed text")} | others
    write(f"{src}/one__v1.txt", b"late old text")
    write(f"{src}/a/readme__v1.txt", b"  ")
    assert run() == {("one.txt", "changed text")} | others - {("a/readme.txt", "in a")}


def test_children_along_timestamps(spark):
    parents = spark.createDataFrame([(1,), (2,)], "k int")
    children = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP'2024-01-02 00:00:00', 'b'), (1, TIMESTAMP'2024-01-01 00:00:00', 'a'), (1, TIMESTAMP'2024-01-02 00:00:00', 'c') AS t(k, at, v)")
    got = upkeep.with_children(parents, children, "k", "at", tie="v").collect()
    assert sorted((r.k, r.v or "", r.position or 0) for r in got) == [(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "", 0)]


def test_csv_files_as_text(spark, tmp_path):
    write(f"{tmp_path}/in/a.csv", b"x,y\n1,2\n")
    write(f"{tmp_path}/in/b.CSV", b"z\n")
    write(f"{tmp_path}/in/c.txt", b"no")
    assert {(os.path.basename(r.source), r.text) for r in folder.csv_documents(spark, str(tmp_path / "in")).collect()} == {("a.csv", "x,y\n1,2"), ("b.CSV", "z")}


def test_table_names_are_quoted():
    assert relations.quoted('a"b') == '"a""b"'


def test_answer_hook_retries(spark, tmp_path):
    log = str(tmp_path / "calls")

    def model(prompt):
        with open(log, "a") as f:
            f.write(".")
        if prompt == "busy" and os.path.getsize(log) < 3:
            raise RuntimeError("429 slow down")
        if prompt == "bad":
            raise RuntimeError("broken")
        return prompt.upper()

    df = spark.createDataFrame([("busy",)], "prompt string").coalesce(1)
    assert answering.with_answers(df, model, base_delay=0.01).first().answer == "BUSY"
    bad = spark.createDataFrame([("bad",)], "prompt string")
    assert answering.with_answers(bad, model, base_delay=0.01).first().answer == "Generate error: broken"


def test_upsert_keeps_creation(spark):
    old = spark.createDataFrame([(1, "a", 10, 10), (2, "b", 11, 11)], "k int, v string, created_at int, updated_at int")
    new = spark.createDataFrame([(1, "c", 20, 20), (3, "d", 21, 21)], "k int, v string, created_at int, updated_at int")
    got = {r.k: (r.v, r.created_at, r.updated_at) for r in upkeep.upserted(old, new, "k", ["v"]).collect()}
    assert got == {1: ("c", 10, 20), 2: ("b", 11, 11), 3: ("d", 21, 21)}
