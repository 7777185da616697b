"""Registered queries: chat logs made from the conversations table."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from corpusloom import lexicon
from corpusloom.operators import chat, patterns
from corpusloom.operators.sizing import shared_folder
from corpusloom.plans import sqltext as s
from corpusloom.plans.registry import Tables, query
from corpusloom.streaming import chats

# every turn is one message of the log of its conversation, in one of four line forms; texts keep their line breaks
TURNS_SQL = """turns AS (SELECT conv_id AS file, turn, role, text,
  TIMESTAMP '2023-01-05 08:00:00' + to_hours(conv_id::INT * 7) + to_minutes(turn::INT * 13) AS ts FROM conversations),
raw AS (SELECT file, turn, CASE WHEN turn = 0 THEN role || ' created group' || chr(10) ELSE '' END || CASE (file + turn) % 4
    WHEN 0 THEN '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] '
    WHEN 1 THEN '[' || strftime(ts, '%d/%m/%Y, %H:%M:%S') || '] '
    WHEN 2 THEN strftime(ts, '%d/%m/%y, %H:%M') || ' - '
    ELSE strftime(ts, '%m/%d/%Y, %I:%M %p') || ' - ' END || role || ' ' || (file % 3) || ': ' || text AS body FROM turns),
pieces AS (SELECT file, turn, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS p FROM raw),
lines AS (SELECT file, turn * 1000000 + p AS line_no, line FROM pieces)"""


def chat_lines(t: Tables):
    ts = F.expr("TIMESTAMP_NTZ '2023-01-05 08:00:00' + make_dt_interval(0, int(conv_id) * 7, int(turn) * 13)")
    turns = t.conversations.select(F.col("conv_id").alias("file"), "turn", "role", "text", ts.alias("ts"))
    form = (F.col("file") + F.col("turn")) % 4
    stamp = lambda f: F.date_format("ts", f)
    head = (
        F.when(form == 0, F.concat(F.lit("["), stamp("yyyy-MM-dd HH:mm:ss"), F.lit("] ")))
        .when(form == 1, F.concat(F.lit("["), stamp("dd/MM/yyyy, HH:mm:ss"), F.lit("] ")))
        .when(form == 2, F.concat(stamp("dd/MM/yy, HH:mm"), F.lit(" - ")))
        .otherwise(F.concat(stamp("MM/dd/yyyy, hh:mm a"), F.lit(" - ")))
    )
    opening = F.when(F.col("turn") == 0, F.concat("role", F.lit(" created group\n"))).otherwise("")
    body = F.concat(opening, head, "role", F.lit(" "), (F.col("file") % 3).cast("string"), F.lit(": "), "text")
    return turns.select("file", "turn", F.posexplode(F.split(body, "\n")).alias("p", "line")).select(
        "file", (F.col("turn") * 1_000_000 + F.col("p") + 1).alias("line_no"), "line"
    )


def _heads() -> str:
    cols = []
    for i, p in enumerate(lexicon.CHAT_LINE_PATTERNS):
        cols.append(f"regexp_extract(line, {s.q('(?i)' + p)}, ['d', 't', 's', 'x']) AS m{i}")
    picks = ", ".join(f"CASE WHEN m{i}.d <> '' AND ts{i} IS NOT NULL THEN {{'ts': ts{i}, 'sender': m{i}.s, 'text': m{i}.x}} END" for i in range(4))
    stamps = ", ".join(f"CASE WHEN m{i}.d <> '' THEN {ts_sql_const(f'm{i}.d', f'm{i}.t')} END AS ts{i}" for i in range(4))
    return f"""clean AS (SELECT file, line_no, {s.strip('line')} AS line FROM lines),
kept AS (SELECT * FROM clean WHERE line <> '' AND NOT regexp_matches(line, {s.q('(?i)' + '|'.join(lexicon.CHAT_SYSTEM_PATTERNS))})),
matched AS (SELECT *, {', '.join(cols)} FROM kept),
stamped AS (SELECT *, {stamps} FROM matched),
heads AS MATERIALIZED (SELECT file, line_no, line, coalesce({picks}) AS head FROM stamped),
marked AS (SELECT *, sum(CASE WHEN head IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line_no) AS msg FROM heads),
messages AS MATERIALIZED (SELECT file, min(line_no) AS line_no, 'wa_' || min(line_no) AS message_id, {s.strip('max(head.sender)')} AS sender, max(head.ts) AS ts,
  string_agg(coalesce({s.strip('head.text')}, line), chr(10) ORDER BY line_no) AS content FROM marked WHERE msg > 0 GROUP BY file, msg)"""


def ts_sql_const(d: str, t: str) -> str:
    """First date format and first time format that fit; years have exactly two or four digits."""
    dates = ["%Y-%m-%d", "%d/%m/%Y", "%d/%m/%y", "%m/%d/%Y", "%m/%d/%y", "%Y/%m/%d"]
    times = ["%H:%M:%S", "%H:%M", "%I:%M:%S %p", "%I:%M %p", "%I:%M%p"]
    digits = {"Y": "/[0-9]{4}$", "y": "/[0-9]{2}$"}
    day = "coalesce(" + ", ".join(
        f"CASE WHEN regexp_matches({d}, '{digits[f[-1]]}') THEN try_strptime({d}, '{f}') END" if f[-1] in digits
        else f"try_strptime({d}, '{f}')"
        for f in dates
    ) + ")"
    clock = "coalesce(" + ", ".join(f"try_strptime('1970-01-01 ' || upper(trim({t})), '%Y-%m-%d {f}')" for f in times) + ", TIMESTAMP '1970-01-01')"
    return f"({day} + ({clock} - TIMESTAMP '1970-01-01'))"


MESSAGES_SQL = f"WITH {TURNS_SQL}, {_heads()}"


@query("c1_parsed_lines", MESSAGES_SQL + " SELECT file, line_no, head.ts AS ts, head.sender AS sender, head.text AS body FROM heads WHERE head IS NOT NULL")
def parsed_lines(t: Tables):
    heads = chat.parsed_lines(chat_lines(t)).filter(F.col("head").isNotNull())
    return heads.select("file", "line_no", "head.ts", "head.sender", F.col("head.text").alias("body"))


ORDER_STAMPS = """st AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y')
  WHEN 2 THEN strftime(o_orderdate, '%d/%m/%y') WHEN 3 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 4 THEN strftime(o_orderdate, '%m/%d/%y') ELSE strftime(o_orderdate, '%Y/%m/%d') END AS d,
  CASE o_orderkey % 5 WHEN 0 THEN '13:05:09' WHEN 1 THEN '7:45' WHEN 2 THEN '01:02:03 PM' WHEN 3 THEN '12:30 am' ELSE '99:99' END AS t FROM orders)"""


@query("c2_timestamps", f"WITH {ORDER_STAMPS} SELECT o_orderkey, {ts_sql_const('d', 't')} AS ts FROM st")
def timestamps(t: Tables):
    k = F.col("o_orderkey")
    fmts = ["yyyy-MM-dd", "dd/MM/yyyy", "dd/MM/yy", "MM/dd/yyyy", "MM/dd/yy", "yyyy/MM/dd"]
    date = F
    for i, f in enumerate(fmts):
        date = date.when(k % 6 == i, F.date_format("o_orderdate", f))
    time = (
        F.when(k % 5 == 0, "13:05:09").when(k % 5 == 1, "7:45").when(k % 5 == 2, "01:02:03 PM")
        .when(k % 5 == 3, "12:30 am").otherwise("99:99")
    )
    return t.orders.select("o_orderkey", chat.parsed_timestamp(date, time).alias("ts"))


@query(
    "c3_system_lines",
    f"WITH {TURNS_SQL} SELECT file, line_no, regexp_matches(line, {s.q('(?i)' + '|'.join(lexicon.CHAT_SYSTEM_PATTERNS))}) AS is_system FROM lines",
)
def system_lines(t: Tables):
    return chat_lines(t).select("file", "line_no", chat.is_system_line(F.col("line")).alias("is_system"))


STREAMED_SQL = MESSAGES_SQL.replace(
    "SELECT file, turn * 1000000 + p AS line_no, line FROM pieces", "SELECT CAST(file AS VARCHAR) AS file, row_number() OVER (PARTITION BY file ORDER BY turn, p) AS line_no, line FROM pieces")


@query("x1_streamed_chats", STREAMED_SQL + " SELECT file, message_id, sender, ts, content FROM messages")
def streamed_chats(t: Tables):
    """Every chat arrives in parts of three lines, in three runs of the stream that each go on from the state of the one before."""
    lines = chat_lines(t).withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy("line_no")) - 1)
    place = F.floor(F.col("nth") / 3)
    piece = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]), "\n")
    parts = lines.groupBy(F.col("file").cast("string").alias("chat"), place.alias("part")).agg(piece.alias("text"))
    base = f"{shared_folder(t.spark).rstrip('/')}/chats-{uuid.uuid4().hex}"
    arrival = F.least(F.col("part") % 4, F.lit(2)).cast("int")  # parts 1 to 3 of a chat come after all its parts 0, 4, 8 ..
    parts.withColumn("arrival", arrival).write.partitionBy("arrival").parquet(f"{base}/all")
    for k in range(3):
        t.spark.read.schema(parts.schema).parquet(f"{base}/all/arrival={k}").write.mode("append").parquet(f"{base}/in")
        stream = t.spark.readStream.schema(parts.schema).parquet(f"{base}/in")
        for run in chats.ingest_chats(stream, f"{base}/table", f"{base}/mark"):
            run.awaitTermination()
    return chats.streamed_messages(t.spark, f"{base}/table").drop("line_no")


@query("c4_messages", MESSAGES_SQL + " SELECT file, message_id, sender, ts, content FROM messages")
def folded_messages(t: Tables):
    return chat.messages(chat_lines(t)).drop("line_no")


@query("c5_preview", "SELECT doc_id, left(text, 1000) AS content_preview, len(text) > 1000 AS truncated FROM documents")
def chat_preview(t: Tables):
    return t.documents.select("doc_id", *[c.alias(n) for n, c in chat.preview(F.col("text"), 1000).items()])


NAMES = {"user 0": "Dev_A", "user 1": "Dev_B", "assistant": "Lead_1", "system": "Ops_1"}


def _pseudonym_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(trim({c})), '{k}') THEN '{v}'" for k, v in sorted(NAMES.items(), key=lambda x: -len(x[0]))) + " ELSE 'Unknown' END"


@query(
    "c7_pseudonyms",
    MESSAGES_SQL + f" SELECT file, message_id, {_pseudonym_sql('sender')} AS sender, regexp_replace(regexp_replace(sender || ' said ' || content, '(?i)user 0', 'Dev_A', 'g'), '(?i)user 1', 'Dev_B', 'g') AS content FROM messages",
)
def pseudonyms(t: Tables):
    said = F.concat("sender", F.lit(" said "), "content")
    return chat.messages(chat_lines(t)).select(
        "file", "message_id", chat.pseudonym(F.col("sender"), NAMES).alias("sender"), chat.masked(said, NAMES).alias("content")
    )


@query(
    "c7_pseudonyms_by_table",
    MESSAGES_SQL + f" SELECT file, message_id, {_pseudonym_sql('sender')} AS sender, regexp_replace(regexp_replace(sender || ' said ' || content, '(?i)user 0', 'Dev_A', 'g'), '(?i)user 1', 'Dev_B', 'g') AS content FROM messages",
)
def pseudonyms_by_table(t: Tables):
    """The dictionary is a table."""
    names = t.spark.createDataFrame(list(NAMES.items()), "name string, alias string")
    said = chat.messages(chat_lines(t)).select("file", "message_id", F.col("sender").alias("raw"), F.concat("sender", F.lit(" said "), "content").alias("content"))
    return patterns.masked_by(patterns.pseudonym_by(said, "raw", names, "sender"), "content", names).select("file", "message_id", "sender", "content")


@query(
    "c8_picture_prefix",
    f"SELECT conv_id, turn, {s.strip('''regexp_replace(regexp_replace(CASE role WHEN 'user' THEN 'Image ' || text ELSE 'selected photo' || text END, '(?i)^image[ \\t\\n\\r]*', ''), '(?i)^Selected photo[ \\t\\n\\r]*', '[foto]')''')} AS content FROM conversations",
)
def picture_prefix(t: Tables):
    text = F.when(F.col("role") == "user", F.concat(F.lit("Image "), "text")).otherwise(F.concat(F.lit("selected photo"), "text"))
    return t.conversations.select("conv_id", "turn", chat.without_picture_prefix(text).alias("content"))


@query(
    "c9_conversation_summary",
    MESSAGES_SQL + " SELECT file, count(*) AS message_count, array_to_string(list_sort(list(DISTINCT sender)), '|') AS participants, min(ts) AS \"start\", max(ts) AS \"end\" FROM messages GROUP BY file",
)
def conversation_summary(t: Tables):
    return chat.summary(chat.messages(chat_lines(t))).withColumn("participants", F.array_join("participants", "|"))


WINDOWS_SQL = """placed AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no) - 1 AS i FROM messages),
spans AS (SELECT file, unnest(range(0, max(i) // 3 + 1)) AS w FROM placed GROUP BY file),
windows AS (SELECT file, w AS "window", string_agg('[' || strftime(ts, '%Y-%m-%d %H:%M') || '] ' || sender || ': ' || content, chr(10) ORDER BY i) AS text,
  count(*) AS message_count, array_to_string(list_sort(list(DISTINCT sender)), '|') AS participants, min(i) AS start_index, max(i) AS end_index, min(ts) AS "start", max(ts) AS "end"
  FROM spans JOIN placed USING (file) WHERE i >= w * 3 AND i < w * 3 + 4 GROUP BY file, w)"""


@query("c10_message_windows", MESSAGES_SQL + f", {WINDOWS_SQL} SELECT * FROM windows")
def message_windows(t: Tables):
    made = chat.windows(chat.messages(chat_lines(t)), 4, 1)
    return made.withColumn("participants", F.array_join("participants", "|"))


def keywords_sql(by: str, n: int, cte: str = "messages") -> str:
    return f"""kw AS (SELECT {by}, line_no, unnest({s.words('content')}) AS word, generate_subscripts({s.words('content')}, 1) AS p FROM {cte}),
kn AS (SELECT {by}, word, count(*) AS n, min(line_no * 100000 + p) AS first FROM kw WHERE len(word) >= 3 AND word NOT IN {s.in_list(lexicon.CHAT_STOPWORDS)}
   AND NOT regexp_matches(word, '^\\p{{Nd}}+$') GROUP BY ALL),
nm AS (SELECT DISTINCT {by}, unnest({s.split_words('lower(sender)')}) AS word FROM {cte}),
kb AS (SELECT kn.{by}, kn.word, n * CASE WHEN nm.word IS NULL THEN 1 ELSE 2 END AS n, first FROM kn LEFT JOIN nm ON nm.{by} = kn.{by} AND nm.word = kn.word),
keywords AS MATERIALIZED ({s.best('kb', by, 'n DESC, first', n, cols=f'{by}, word, n, rank')})"""


@query("c11_keywords", MESSAGES_SQL + f", {keywords_sql('file', 20)} SELECT * FROM keywords")
def chat_keywords(t: Tables):
    return chat.keywords(chat.messages(chat_lines(t)), 20)


EXPORT_SQL = """body AS (SELECT file AS source, line_no AS seq, '[' || strftime(ts, '%d/%m/%Y, %H:%M:%S') || '] ' || sender || ': ' || content AS line FROM messages),
mem AS (SELECT file AS source, string_agg(sender || ' (' || CASE sender WHEN 'user 0' THEN 'Developer' ELSE 'Unknown Role' END || ')', ', ' ORDER BY first) AS members
  FROM (SELECT file, sender, min(line_no) AS first FROM messages WHERE sender <> 'Unknown' GROUP BY ALL) GROUP BY file),
src AS (SELECT DISTINCT file AS source, 'chat ' || file AS label, 'conversation' AS topic FROM messages),
hd AS (SELECT source, unnest([-4, -3, -2, -1]) AS seq, unnest(['--- GRUP: ' || label || ' ---', '--- Anggota: ' || coalesce(members, 'Unknown') || ' ---', '--- Konteks: ' || topic || ' ---', '']) AS line
  FROM src LEFT JOIN mem USING (source))"""


@query("s9_clean_export", MESSAGES_SQL + f", {EXPORT_SQL} SELECT * FROM body UNION ALL SELECT * FROM hd")
def clean_export(t: Tables):
    msgs = chat.messages(chat_lines(t)).withColumnRenamed("file", "source")
    sources = t.conversations.select(F.col("conv_id").alias("source")).distinct().select(
        "source", F.concat(F.lit("chat "), F.col("source").cast("string")).alias("label"), F.lit("conversation").alias("topic")
    )
    return chat.clean_lines(msgs, sources, {"user 0": "Developer"})


def pasted_lines(t: Tables):
    """Conversations in the form of a pasted chat: preview, name, time, blank line, text, blank line."""
    stamp = F.date_format(
        F.expr("TIMESTAMP_NTZ '2023-01-05 08:00:00' + make_dt_interval(0, int(conv_id) * 7, int(turn) * 13)"), "M/d/yyyy h:mm a"
    )
    name = F.concat(F.initcap("role"), F.lit(" Person"))
    body = F.concat(F.lit("new message by "), name, F.lit("\n"), name, F.lit("\n"), stamp, F.lit("\n\n"), "text", F.lit("\n\nUnread\n12"))
    return t.conversations.select(
        F.col("conv_id").alias("file"), "turn", F.posexplode(F.split(body, "\n")).alias("p", "line")
    ).select("file", (F.col("turn") * 1_000_000 + F.col("p") + 1).alias("line_no"), "line")


# the first lines of a text that are not blank, joined with spaces, when no line of it looks like a preview, noise or quote line
@query("c6_pasted_messages")
def pasted_messages(t: Tables):
    return chat.pasted_messages(pasted_lines(t), {"user person": "Dev_A", "assistant person": "Lead_1"})
