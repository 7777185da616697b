"""Chat logs that arrive in parts: messages whose lines lie in several parts, and several batches, are folded through keyed state.

A part is (chat, part, text): the next lines of a chat, parts numbered from 0.
Inside a part, lines are parsed and folded where it is read.  Only what crosses
the border of a part goes by chat: its number of lines, the lines before its
first message, and its last message, which may go on.  The state of a chat is
its next part, the lines counted so far, the open message, and parts that came
before their predecessors.  All other messages are written as they are, with
line numbers inside the part; readers add the number of lines before it.

Every batch writes its own partition of the two tables, and a repeated batch
overwrites only that, so a restart neither loses nor doubles a message.  A part
that was already taken in is not taken again.  A chat can be read at any time:
its open message is there with the lines seen so far.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.functions.text import strip
from corpusloom.functions.words import let
from corpusloom.operators import chat
from corpusloom.operators.sizing import best

PART_MARK = r"__p([0-9]+)(\.[^./]+)?$"
STATE = "next bigint, lines bigint, open string, early string"
BORDERS = "chat string, part bigint, before bigint, line_no bigint, sender string, ts string, content string, seen bigint"
STAMP = "yyyy-MM-dd HH:mm:ss"


def arriving_parts(spark: SparkSession, folder: str) -> DataFrame:
    """(chat, part, text) of files named ``chat__p0.txt``, ``chat__p1.txt`` and so on, as they appear; a name without a mark is part 0."""
    raw = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder)
    path, base = F.col("_metadata.file_path"), folder.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    below = F.substring(path, F.instr(path, base) + len(base), F.length(path))
    part = F.coalesce(F.nullif(F.regexp_extract(below, PART_MARK, 1), F.lit("")).cast("long"), F.lit(0))
    return raw.select(F.regexp_replace(below, PART_MARK, "$2").alias("chat"), part.alias("part"), F.col("value").alias("text"))


def _folded(lines: Column) -> Column:
    """struct<lead, messages> of an array of lines: text before the first message, and messages with the line they start in."""
    def entry(line: Column, i: Column) -> Column:
        clean = strip(line)
        return let(chat.parsed_line(clean), lambda head: F.struct(
            (i + 1).cast("long").alias("line_no"), head.alias("head"), clean.alias("line"),
            ((clean != "") & ~chat.is_system_line(clean)).alias("kept")))

    def fold(rows: Column) -> Column:
        text = F.transform(rows, lambda x: F.coalesce(strip(x["head"]["text"]), x["line"]))
        starts = F.filter(F.sequence(F.lit(1), F.size(rows) + 1), lambda i: (i > F.size(rows)) | F.element_at(rows, i)["head"].isNotNull())
        return let(text, lambda t: let(starts, lambda s: F.struct(
            F.array_join(F.slice(t, F.lit(1), F.element_at(s, 1) - 1), "\n").alias("lead"),
            F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda at, k: F.struct(
                F.element_at(rows, at)["line_no"].alias("line_no"), strip(F.element_at(rows, at)["head"]["sender"]).alias("sender"),
                F.element_at(rows, at)["head"]["ts"].alias("ts"), F.array_join(F.slice(t, at, F.element_at(s, k + 2) - at), "\n").alias("content"))).alias("messages"))))

    some = F.filter(F.transform(lines, entry), lambda x: x["kept"])
    return let(some, lambda rows: F.when(F.size(rows) > 0, fold(rows)))


def folded_parts(parts: DataFrame) -> DataFrame:
    """(chat, part, n_lines, lead, messages) per part, nothing crosses a row."""
    lines = parts.select("chat", F.col("part").cast("long").alias("part"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    return lines.select("chat", "part", F.size("lines").cast("long").alias("n_lines"), _folded(F.col("lines")).alias("x")).select(
        "chat", "part", "n_lines", F.coalesce("x.lead", F.lit("")).alias("lead"), F.coalesce("x.messages", F.array()).alias("messages"))


def _inner(folded: DataFrame) -> DataFrame:
    """Messages of a part that end inside it."""
    whole = F.slice("messages", F.lit(1), F.greatest(F.size("messages") - 1, F.lit(0)))
    return folded.select("chat", "part", F.explode(whole).alias("m")).select("chat", "part", "m.*")


def _crossed(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Take the parts of one chat in order; gives where each one starts, and the messages that crossed a border."""
    following, lines, open_, early = state.get if state.exists else (0, 0, "null", "{}")
    message, waiting = json.loads(open_), json.loads(early)
    for frame in frames:
        for row in frame.itertuples(index=False):
            if row.part >= following:
                last = None if pd.isna(row.line_no) else [int(row.line_no), row.sender, row.ts, row.content]
                waiting.setdefault(str(row.part), [int(row.n_lines), row.lead, last])
    out = []

    def give(m: list) -> None:
        out.append((key[0], None, None, *m, following))

    while str(following) in waiting:
        n, lead, last = waiting.pop(str(following))
        out.append((key[0], following, lines, None, None, None, None, None))
        if message and lead:
            message[3] += "\n" + lead
        following += 1
        if last:
            if message:
                give(message)
            message = [last[0] + lines, *last[1:]]
        lines += n
    if message and out:
        give(message)
    state.update((following, lines, json.dumps(message), json.dumps(waiting)))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in BORDERS.split(", ")]).astype({"part": "Int64", "before": "Int64", "line_no": "Int64", "seen": "Int64"})


def borders(folded: DataFrame) -> DataFrame:
    """Offsets of parts and messages across their borders, from keyed state."""
    last = F.when(F.size("messages") > 0, F.element_at("messages", -1))
    few = folded.select("chat", "part", "n_lines", "lead", last.alias("m")).select(
        "chat", "part", "n_lines", "lead", "m.line_no", "m.sender", F.date_format("m.ts", STAMP).alias("ts"), "m.content")
    return few.groupBy("chat").applyInPandasWithState(_crossed, BORDERS, STATE, "append", GroupStateTimeout.NoTimeout)


def _sink(table: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    return write


def ingest_chats(parts: DataFrame, table: str, checkpoint: str) -> list[StreamingQuery]:
    """Start a run over all parts that have arrived; both queries stop when they have caught up."""
    folded = folded_parts(parts)
    return [
        df.writeStream.foreachBatch(_sink(f"{table}/{name}")).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()
        for name, df in (("inner", _inner(folded)), ("borders", borders(folded)))
    ]


def streamed_messages(spark: SparkSession, table: str) -> DataFrame:
    """(file, line_no, message_id, sender, ts, content) of all chats, as one batch over their whole texts would give."""
    crossed = spark.read.schema(BORDERS + ", batch bigint").parquet(f"{table}/borders")
    inner = spark.read.schema("chat string, part bigint, line_no bigint, sender string, ts timestamp_ntz, content string, batch bigint").parquet(f"{table}/inner")
    # one row per part, and at most one open message per chat and batch
    starts = crossed.filter(F.col("part").isNotNull()).select("chat", "part", "before").distinct()
    once = best(inner, ["chat", "part", "line_no"], [F.asc("batch")], 1, "nth").drop("nth", "batch")
    moved = once.join(starts, ["chat", "part"]).select("chat", (F.col("line_no") + F.col("before")).alias("line_no"), "sender", "ts", "content")
    newest = best(crossed.filter(F.col("part").isNull()), ["chat", "line_no"], [F.desc("seen")], 1, "nth")
    every = moved.unionByName(newest.select("chat", "line_no", "sender", F.to_timestamp_ntz("ts", F.lit(STAMP)).alias("ts"), "content"))
    return every.select(F.col("chat").alias("file"), "line_no", F.concat(F.lit("wa_"), F.col("line_no").cast("string")).alias("message_id"), "sender", "ts", "content")


# the state function is pickled by value, so executors need no copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])
