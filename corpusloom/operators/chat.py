"""Chat logs: line parsing, message folding, windows, keywords, pasted chats, pseudonyms and search.

Raw lines are (file, line_no, line); messages are (file, line_no, message_id, sender, ts, content).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom import lexicon
from corpusloom.functions.text import split_words, strip
from corpusloom.functions.words import let, matches_any, words
from corpusloom.operators.ordering import numbered, running_sum
from corpusloom.operators.sizing import best
from corpusloom.settings import DEFAULTS


def decoded(content: Column) -> Column:
    """Bytes of a chat export as text: UTF-8 (with or without mark), else UTF-16 with mark, else Latin-1."""
    mark = F.hex(F.substring(content, 1, 2))
    valid = F.is_valid_utf8(content.cast("string"))
    return F.regexp_replace(
        F.when(valid, content.cast("string"))
        .when(mark.isin("FFFE", "FEFF"), F.decode(content, "UTF-16"))
        .otherwise(F.decode(content, "ISO-8859-1")),
        "^﻿", "",
    )


def lines_of(files: DataFrame) -> DataFrame:
    """(file, text) to (file, line_no, line), counted from 1."""
    return files.select("file", F.posexplode(F.split("text", "\n")).alias("p", "line")).select(
        "file", (F.col("p") + 1).cast("long").alias("line_no"), "line"
    )


def read_as(c: Column, fmt: str) -> Column:
    """Timestamp in one format; texts of another digit shape are not tried, since a failed try is costly."""
    return F.when(c.rlike(lexicon.CHAT_SHAPES[fmt]), F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz"))


def parsed_date(c: Column) -> Column:
    """First date format that fits; two-digit years from 69 on are 19xx."""
    tries = []
    for fmt in lexicon.CHAT_DATE_FORMATS:
        day = read_as(c, fmt)
        if "yyyy" not in fmt:
            day = F.when(F.year(day) >= 2069, day - F.expr("INTERVAL '100' YEAR")).otherwise(day)
        tries.append(day)
    return F.coalesce(*tries)


def parsed_timestamp(date: Column, time: Column) -> Column:
    """Date with the first time format that fits, or the bare date at midnight."""
    clock = F.upper(F.trim(time))
    seconds = F.coalesce(
        *[
            F.hour(x) * 3600 + F.minute(x) * 60 + F.second(x)
            for x in [read_as(clock, f) for f in lexicon.CHAT_TIME_FORMATS]
        ],
        F.lit(0),
    )
    return parsed_date(date) + F.make_dt_interval(secs=seconds)


def parsed_line(line: Column) -> Column:
    """struct<ts, sender, text> of the first pattern that fits, if its date can be read, else null.

    Patterns that fit the same line agree on its date, so one date and one time
    are read per line.
    """
    tries = []
    for pattern in lexicon.CHAT_LINE_PATTERNS:
        part = lambda i: F.regexp_extract(line, "(?i)" + pattern, i)  # noqa: B023, E731
        tries.append(F.when(part(1) != "", F.struct(part(1).alias("date"), part(2).alias("time"), part(3).alias("sender"), part(4).alias("text"))))

    def read(x: Column) -> Column:
        return let(
            F.when(x.isNotNull(), parsed_timestamp(x["date"], x["time"])),
            lambda ts: F.when(ts.isNotNull(), F.struct(ts.alias("ts"), x["sender"].alias("sender"), x["text"].alias("text"))),
        )

    return let(F.coalesce(*tries), read)


def is_system_line(line: Column) -> Column:
    return line.rlike("(?i)" + "|".join(lexicon.CHAT_SYSTEM_PATTERNS))


def parsed_lines(lines: DataFrame) -> DataFrame:
    clean = lines.select("file", "line_no", strip(F.col("line")).alias("line")).filter(
        (F.col("line") != "") & ~is_system_line(F.col("line"))
    )
    return clean.withColumn("head", parsed_line(F.col("line")))


def messages(lines: DataFrame) -> DataFrame:
    """Fold continuation lines into the message before them; lines before the first message are dropped."""
    heads = parsed_lines(lines)
    grouped = running_sum(heads, ["file"], "line_no", F.col("head").isNotNull().cast("int"), "message").filter(
        F.col("message") > 0
    )
    piece = F.struct("line_no", F.coalesce(strip(F.col("head.text")), F.col("line")).alias("text"))
    return grouped.groupBy("file", "message").agg(
        F.min("line_no").alias("line_no"),
        strip(F.max("head.sender")).alias("sender"),
        F.max("head.ts").alias("ts"),
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["text"]), "\n").alias("content"),
    ).select(
        "file", "line_no", F.concat(F.lit("wa_"), F.col("line_no").cast("string")).alias("message_id"),
        "sender", "ts", "content",
    )


def summary(msgs: DataFrame) -> DataFrame:
    return msgs.groupBy("file").agg(
        F.count(F.lit(1)).alias("message_count"),
        F.array_sort(F.collect_set("sender")).alias("participants"),
        F.min("ts").alias("start"),
        F.max("ts").alias("end"),
    )


def preview(text: Column, max_chars: int = 20_000) -> dict[str, Column]:
    n = min(max(max_chars, 500), 200_000)
    return {"content_preview": F.substring(text, 1, n), "truncated": F.length(text) > n}


def windows(msgs: DataFrame, size: int = DEFAULTS.window_size, overlap: int = DEFAULTS.window_overlap) -> DataFrame:
    """Overlapping windows of messages, including the short tail.

    A message knows the windows that hold it from its own position, so groups
    have at most ``size`` rows whatever the length of the file.
    """
    step = size - overlap
    placed = numbered(msgs, ["file"], "line_no", "__n").withColumn("__i", (F.col("__n") - 1).cast("long"))
    first = F.greatest(F.lit(0), F.ceil((F.col("__i") - size + 1) / step)).cast("long")
    held = placed.withColumn("window", F.explode(F.sequence(first, F.floor(F.col("__i") / step).cast("long"))))
    line = F.concat(
        F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("] "), F.col("sender"), F.lit(": "), F.col("content")
    )
    return held.groupBy("file", "window").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("__i", line.alias("line")))), lambda x: x["line"]), "\n"
        ).alias("text"),
        F.count(F.lit(1)).alias("message_count"),
        F.array_sort(F.collect_set("sender")).alias("participants"),
        F.min("__i").alias("start_index"),
        F.max("__i").alias("end_index"),
        F.min("ts").alias("start"),
        F.max("ts").alias("end"),
    )


def keywords(msgs: DataFrame, top_n: int = 20, min_length: int = 3, by: str = "file") -> DataFrame:
    """Most frequent words per file; words that are part of a sender's name count twice; earlier words win ties."""
    found = (
        msgs.select(by, "line_no", F.posexplode(words(F.col("content"))).alias("p", "word"))
        .filter(
            (F.length("word") >= min_length)
            & ~F.col("word").isin(*lexicon.CHAT_STOPWORDS)
            & ~F.col("word").rlike(r"^\p{Nd}+$")
        )
        .groupBy(by, "word")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("line_no", "p")).alias("first"))
    )
    names = msgs.select(by, F.explode(split_words(F.lower(F.col("sender")))).alias("word")).distinct()
    counted = found.join(names.withColumn("named", F.lit(2)), [by, "word"], "left").withColumn(
        "n", F.col("n") * F.coalesce("named", F.lit(1))
    )
    return best(counted, [by], [F.desc("n"), F.asc("first")], top_n).select(by, "word", "n", "rank")


# pseudonyms ---------------------------------------------------------------------------------------


def _by_length(names: dict[str, str]) -> list[tuple[str, str]]:
    return sorted(names.items(), key=lambda x: -len(x[0]))


def pseudonym(raw: Column, names: dict[str, str]) -> Column:
    """First name of the user's dictionary found in the text, longest first, else Unknown."""
    low = F.lower(F.trim(raw))
    return F.coalesce(*[F.when(low.contains(real), F.lit(alias)) for real, alias in _by_length(names)], F.lit("Unknown"))


def masked(text: Column, names: dict[str, str]) -> Column:
    """Replace names of several words, whatever their case."""
    for real, alias in _by_length(names):
        if " " in real:
            quoted = "".join("\\" + ch if not (ch.isalnum() or ch == " ") else ch for ch in real)
            text = F.regexp_replace(text, "(?i)" + quoted, alias)
    return text


def without_picture_prefix(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?i)^image\s*", ""), r"(?i)^Selected photo\s*", "[foto]"))


# pasted chats -------------------------------------------------------------------------------------


def pasted_messages(lines: DataFrame, names: dict[str, str]) -> DataFrame:
    """Messages of a pasted chat, where a preview line ``... by <name>`` opens a block.

    A block holds header lines (time and name in any order) and, after a blank
    line or from the first other line, the text up to the next blank line.  The
    blocks are numbered by a running count of preview lines, so a long file is
    spread over tasks and each group is one block.
    """
    t = strip(F.col("line"))
    kind = (
        F.when(t == "", "blank")
        .when(t.rlike(lexicon.PASTED_PREVIEW), "preview")
        .when(t.rlike(lexicon.PASTED_TIME), "time")
        .when(
            matches_any(F.lower(t), ["\\Q" + n + "\\E" for n in names] or ["$^"])
            | (t.rlike(lexicon.PASTED_NAME) & (F.size(split_words(t)) <= 5)),
            "name",
        )
        .otherwise("other")
    )
    kept = lines.filter((t == "") | ~(t.rlike(lexicon.PASTED_NOISE) | t.rlike(lexicon.PASTED_QUOTE))).select(
        "file", "line_no", t.alias("text"), kind.alias("kind")
    )
    blocks = running_sum(kept, ["file"], "line_no", (F.col("kind") == "preview").cast("int"), "block").filter(
        F.col("block") > 0
    )
    grouped = blocks.groupBy("file", "block").agg(
        F.min("line_no").alias("line_no"),
        F.array_sort(F.collect_list(F.struct("line_no", "kind", "text"))).alias("ls"),
    )

    def first_of(ls: Column, kinds: list[str]) -> Column:
        """Position from 1 of the first line of one of the kinds, 0 when there is none."""
        return F.array_position(F.transform(ls, lambda x: x["kind"].isin(*kinds)), True)

    def after(ls: Column, n: Column) -> Column:
        return F.filter(ls, lambda x, i: i >= n)

    def before(ls: Column, n: Column) -> Column:
        return F.filter(ls, lambda x, i: i < n)

    def last_text(ls: Column, kind: str) -> Column:
        return F.try_element_at(F.filter(ls, lambda x: x["kind"] == kind), F.lit(-1))["text"]

    ls = F.col("ls")
    at_time = grouped.withColumn("d", first_of(ls, ["time"])).filter(F.col("d") > 0)
    with_head = (
        at_time.withColumn("tail", after(ls, F.col("d") - 1))
        .withColumn("h", first_of(F.col("tail"), ["blank", "other"]))
        .filter(F.col("h") > 0)
        .withColumn("head", before(ls, F.col("d") + F.col("h") - 2))
    )
    opens = F.when(F.element_at("tail", F.col("h").cast("int"))["kind"] == "blank", F.col("h")).otherwise(F.col("h") - 1)
    with_body = with_head.withColumn("rest", after(F.col("tail"), opens)).withColumn(
        "e", first_of(F.col("rest"), ["blank"])
    )
    body = F.when(F.col("e") > 0, before(F.col("rest"), F.col("e") - 1)).otherwise(F.col("rest"))
    texts = F.filter(F.transform(body, lambda x: without_picture_prefix(x["text"])), lambda x: x != "")
    stamp = last_text(F.col("head"), "time")
    ts = F.try_to_timestamp(
        F.upper(F.regexp_replace(stamp, r"(?i)\s*([AP]M)$", " $1")), F.lit("M/d/yyyy h:m a")
    ).cast("timestamp_ntz")
    shown = F.regexp_extract(F.element_at("ls", 1)["text"], r"\sby\s(.+)$", 1)
    return with_body.select(
        "file", "line_no", ts.alias("ts"),
        pseudonym(F.coalesce(last_text(F.col("head"), "name"), shown), names).alias("sender"),
        masked(without_picture_prefix(F.array_join(texts, " ")), names).alias("content"),
    ).filter((F.col("content") != "") & F.col("ts").isNotNull())


# clean export -------------------------------------------------------------------------------------


def clean_lines(msgs: DataFrame, sources: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Text lines (source, seq, line): three header lines and a blank one, then the messages in order.

    ``msgs`` has source, line_no, sender, ts, content; ``sources`` has source, label, topic.
    Members stand in the order of their first message.
    """
    role = F.coalesce(
        *[F.when(F.col("sender") == who, F.lit(what)) for who, what in roles.items()], F.lit("Unknown Role")
    )
    members = (
        msgs.filter(F.col("sender") != "Unknown")
        .groupBy("source", "sender").agg(F.min("line_no").alias("first"))
        .groupBy("source")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("first", F.concat("sender", F.lit(" ("), role, F.lit(")")).alias("m")))),
                    lambda x: x["m"],
                ),
                ", ",
            ).alias("members")
        )
    )
    head = sources.join(members, "source", "left").select(
        "source",
        F.posexplode(
            F.array(
                F.concat(F.lit("--- GRUP: "), "label", F.lit(" ---")),
                F.concat(F.lit("--- Anggota: "), F.coalesce("members", F.lit("Unknown")), F.lit(" ---")),
                F.concat(F.lit("--- Konteks: "), "topic", F.lit(" ---")),
                F.lit(""),
            )
        ).alias("p", "line"),
    )
    body = msgs.select(
        "source", F.col("line_no").cast("long").alias("seq"),
        F.concat(F.lit("["), F.date_format("ts", "dd/MM/yyyy, HH:mm:ss"), F.lit("] "), "sender", F.lit(": "), "content").alias("line"),
    )
    return head.select("source", (F.col("p") - 4).cast("long").alias("seq"), "line").unionByName(body)
