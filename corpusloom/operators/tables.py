"""Search in relational tables, and tables as text.

A searchable table is a frame with a key column and text columns.  The terms of
all questions are found in one pass over the rows of all tables, where they are
read; only the best rows of each task are exchanged.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom import lexicon
from corpusloom.functions import kernels, questions as qf
from corpusloom.functions.words import stem
from corpusloom.operators.ordering import balanced
from corpusloom.operators.sizing import best, cut_lineage, distinct_sets, hinted, pattern_slices
from corpusloom.settings import DEFAULTS, Settings

PART = r"[\p{L}\p{N}_+]+"


@dataclass(frozen=True)
class Searchable:
    """A table to search: its rows, key, text columns, and the column whose exact hits count most."""

    label: str
    rows: DataFrame
    key: str
    text_columns: tuple[str, ...]
    name_column: str | None = None
    indexed_columns: tuple[str, ...] = ()

    @property
    def index(self) -> tuple[str, ...]:
        return self.indexed_columns or self.text_columns


def text_of(columns) -> Column:
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])


def row_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(PART), F.lit(0))


def _asked(questions: DataFrame, routes: DataFrame | None, settings: Settings) -> tuple[list, DataFrame]:
    """What the tasks get: slices of the different sets (set_id, terms, stems, phrases, tables) of a bounded size, as broadcasts; and (set_id, question_id)."""
    def listed(c: Column) -> Column:
        return F.sort_array(F.array_distinct(c))

    stems = F.filter(F.array_distinct(F.transform("terms", lambda t: stem(t, lexicon.STEM_SUFFIXES_TABLE))), lambda t: F.length(t) >= 2)
    asked = questions.select(
        "question_id", listed(F.transform("terms", lambda t: F.lower(t))).alias("terms"), F.sort_array(stems).alias("stems"),
        listed(F.transform("phrases", lambda p: F.lower(p))).alias("phrases"))
    lists = ["terms", "stems", "phrases"]
    if routes is not None:
        asked = asked.join(routes.groupBy("question_id").agg(F.sort_array(F.collect_set("table")).alias("tables")), "question_id")
    owners, sets = distinct_sets(asked, asked.columns[1:])
    context = questions.sparkSession.sparkContext
    return [context.broadcast(x) for x in pattern_slices(sets, lists, settings)], owners


def _readable(tables: list[Searchable], ranked: bool) -> DataFrame:
    """Rows of all tables alike: (t, num, row_id, texts, words), with the number of the table, an integer key as a number, lower-case texts and marked words.

    Only a word search of a table with a name column reads words.
    """
    whole = {"tinyint", "smallint", "int", "bigint"}
    found = []
    for i, table in enumerate(tables):
        key = F.col(table.key)
        words = F.concat(F.lit(kernels.WORD_START), F.array_join(F.array_distinct(row_words(text_of(table.index))), kernels.WORD_START))
        found.append(table.rows.select(
            F.lit(i).alias("t"), (key if dict(table.rows.dtypes)[table.key] in whole else F.lit(None)).cast("long").alias("num"), key.cast("string").alias("row_id"),
            F.array(*[F.lower(F.col(c).cast("string")) for c in _slots(table)]).alias("texts"),
            (words if ranked and table.name_column is not None else F.lit(None).cast("string")).alias("words")))
    return reduce(DataFrame.unionByName, found)


def _slots(table: Searchable) -> list[str]:
    """The text columns, and the name column behind them if it is none of them."""
    named = table.name_column is not None and table.name_column not in table.text_columns
    return [*table.text_columns, *([table.name_column] if named else [])]


def _hits(
    questions: DataFrame, tables: list[Searchable], limit: int, ranked: bool, parts: bool, routes: DataFrame | None = None, settings: Settings = DEFAULTS,
) -> DataFrame:
    """(question_id, table, row_id, num, kind, score): the best rows of each question and table; ``kind`` is 0 for word search and 1 for substring search.

    Questions with the same terms and phrases are searched once.  Texts stay where
    they are read: every task finds all terms, stems and phrases of a slice of
    questions in one pass over its texts.  Rows with the same matches are alike to
    every question, so a task looks at the first ``limit`` of them only, and it
    gives out rows that can still be among the best, so neither texts nor pairs of
    rows and questions are exchanged, however many rows a term matches.
    """
    slices, owners = _asked(questions, routes, settings)
    layout = [(t.label, len(t.text_columns), _slots(t).index(t.name_column) if t.name_column is not None else None) for t in tables]
    shape = "set_id bigint, t int, num bigint, row_id string, kind int, n_found bigint, n_stems bigint, extra bigint"
    if not slices:
        met = questions.sparkSession.createDataFrame([], shape)
    else:
        rows = _readable(tables, ranked)
        met = reduce(DataFrame.unionByName, [rows.mapInArrow(kernels.table_hits(held, layout, limit, ranked, parts), shape) for held in slices])
    labels = F.array(*[F.lit(t.label) for t in tables])
    score = F.when(F.col("kind") == 0, F.round(F.col("n_found") / F.col("n_stems") + F.col("extra"), 6)).otherwise((F.col("n_found") + F.col("extra")).cast("double"))
    met = met.select("set_id", F.get(labels, F.col("t")).alias("table"), "row_id", "num", "kind", score.alias("score"))
    found = cut_lineage(best(met, ["set_id", "table"], [F.asc("kind"), *_row_order()], limit).drop("rank"))
    return found.join(hinted(owners, settings), "set_id").select("question_id", "table", "row_id", "num", "kind", "score")


def _row_order() -> list[Column]:
    return [F.desc("score"), F.asc("num"), F.asc("row_id")]


def search_ranked(questions: DataFrame, table: Searchable, limit: int = DEFAULTS.table_hit_limit) -> DataFrame:
    """Word search with stems and prefixes; any term may match.

    questions (question_id, terms, phrases).  The score is the share of stems
    found, plus 50 per term inside the name column and 20 per phrase and text
    column.  A table without a name column gives no rows.  Equal scores go by
    key: integers by value, other keys by their text.
    """
    hits = _hits(questions, [table], limit, ranked=True, parts=False)
    return best(hits, ["question_id"], _row_order(), limit).select("question_id", "row_id", "score")


def search_parts(questions: DataFrame, table: Searchable, limit: int = DEFAULTS.table_hit_limit) -> DataFrame:
    """Substring search: one point per different term and column, ten per phrase and column."""
    hits = _hits(questions, [table], limit, ranked=False, parts=True)
    return best(hits, ["question_id"], _row_order(), limit).select("question_id", "row_id", "score")


def search_table(questions: DataFrame, table: Searchable, limit: int = DEFAULTS.table_hit_limit) -> DataFrame:
    """Word search first; substring search only for questions without any word hit."""
    return search_tables(questions, [table], None, limit)


def search_tables(
    questions: DataFrame, tables: list[Searchable], routes: DataFrame | None = None, limit: int = DEFAULTS.table_hit_limit
) -> DataFrame:
    """Search every table, or only the tables that ``routes`` (question_id, table) names for a question, in one pass over all of them."""
    hits = _hits(questions, tables, limit, True, True, routes)
    first = best(hits, ["question_id", "table"], [F.asc("kind"), *_row_order()], limit)
    found = first.withColumn("least", F.min("kind").over(Window.partitionBy("question_id", "table")))
    return found.filter(F.col("kind") == F.col("least")).select("question_id", "row_id", "score", "table")


def search_all_words(questions: DataFrame, tables: list[Searchable], limit: int = DEFAULTS.table_hit_limit) -> DataFrame:
    """Rows that hold all words of a question, one ranking over all tables.  questions (question_id, words)."""
    one = F.array_distinct("words")
    asked = questions.groupBy("question_id").agg(
        F.sort_array(F.flatten(F.collect_list(one))).alias("patterns"), F.max(F.size(one)).cast("long").alias("need")).filter(F.size("patterns") > 0)
    owners, sets = distinct_sets(asked, ["patterns", "need"])
    sets = sets.withColumn("weights", F.transform("patterns", lambda w: F.lit(1).cast("long")))
    # rows with the same key are one
    rows = reduce(DataFrame.unionByName, [
        table.rows.select(F.col(table.key).cast("string").alias("row_id"), F.array_distinct(row_words(text_of(table.index))).alias("words"))
        .groupBy("row_id").agg(F.flatten(F.collect_list("words")).alias("found")).withColumn("table", F.lit(table.label))
        for table in tables])
    order = [F.asc("table"), F.asc(F.length("row_id")), F.asc("row_id")]
    found = list_matches(rows, sets, limit).select("set_id", "row_id", "table")
    first = cut_lineage(best(found, ["set_id"], order, limit).drop("rank"))
    return best(first.join(hinted(owners), "set_id").drop("set_id"), ["question_id"], order, limit).select("question_id", "row_id", "table", "rank")


def list_matches(rows: DataFrame, sets: DataFrame, limit: int, settings: Settings = DEFAULTS) -> DataFrame:
    """(set_id, table, row_id, score): rows (table, row_id, found) that may be among the best of the sets (set_id, patterns, weights, need)."""
    context = rows.sparkSession.sparkContext
    held = [context.broadcast(x) for x in pattern_slices(sets, ["patterns"], settings)]
    shape = "set_id bigint, table string, row_id string, score double"
    if not held:
        return rows.sparkSession.createDataFrame([], shape)
    rows = cut_lineage(rows.select("table", "row_id", "found")) if len(held) > 1 else rows
    return reduce(DataFrame.unionByName, [rows.mapInArrow(kernels.list_hits(x, limit), shape) for x in held])


def like_any(rows: DataFrame, columns: list[str], terms: list[str], limit: int | None = None, order: str | None = None) -> DataFrame:
    """Rows where any column contains any of the given terms, ignoring case; all of them without a limit."""
    test = F.lit(False)
    for c in columns:
        low = F.lower(F.col(c).cast("string"))
        for term in terms:
            test = test | low.contains(term.lower())
    found = rows.filter(test)
    if limit is None:
        return found
    if order is None:
        raise ValueError("a limit needs an order")
    return found.orderBy(order).limit(limit)


# tables as text -----------------------------------------------------------------------------------


def cell(c: str) -> Column:
    text = F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), "\n", " ")


def record_text(columns: list[str]) -> Column:
    """``name: value`` lines; a missing value reads None."""
    return F.concat_ws(
        "\n", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in columns]
    )


def markdown_blocks(rows: DataFrame, label: str, columns: list[str], order: str, block_rows: int = DEFAULTS.connected_block_rows) -> DataFrame:
    """(label, block, content): markdown tables of at most ``block_rows`` key values each.

    A block covers a range of the integer key, so a large table becomes many
    documents and never one cell.
    """
    head = "\n".join(
        [f"Tabel: {label}", "", "| " + " | ".join(columns) + " |", "|" + "|".join(["---"] * len(columns)) + "|"]
    )
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    return (
        rows.select(F.floor(F.col(order) / block_rows).cast("long").alias("block"), F.col(order).alias("__o"), line.alias("line"))
        .groupBy("block")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__o", "line"))), lambda x: x["line"]), "\n").alias("body"))
        .select(F.lit(label).alias("label"), "block", F.concat(F.lit(head + "\n"), "body").alias("content"))
    )


def row_blocks(rows: DataFrame, label: str, columns: list[str], order: list[str], block_rows: int = DEFAULTS.connected_block_rows) -> DataFrame:
    """(label, block, content): markdown tables of exactly ``block_rows`` rows (the last may be shorter), for keys of any kind.

    Rows are numbered over the whole table, so repeated keys are divided and sparse ones do not give short blocks.
    """
    head = "\n".join(
        [f"Tabel: {label}", "", "| " + " | ".join(columns) + " |", "|" + "|".join(["---"] * len(columns)) + "|"]
    )
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    numbered = balanced(rows.select(*order, line.alias("__line")), order, "__n")
    return (
        numbered.groupBy(F.floor(F.col("__n") / block_rows).cast("long").alias("block"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__line"))), lambda x: x["__line"]), "\n").alias("body"))
        .select(F.lit(label).alias("label"), "block", F.concat(F.lit(head + "\n"), "body").alias("content"))
    )


# aggregates ---------------------------------------------------------------------------------------


def numeric_columns(rows: DataFrame) -> list[str]:
    kinds = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return [n for n, k in rows.dtypes if k in kinds or k.startswith("decimal")]


def all_aggregates(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, agg, value) for every numeric column, one pass and one small row per table."""
    out = []
    for label, rows in tables.items():
        columns = numeric_columns(rows)
        if not columns:
            continue
        aggs = [F.count(F.lit(1)).cast("double").alias("*|COUNT")]
        for c in columns:
            for name, f in [("SUM", F.sum), ("AVG", F.avg), ("MIN", F.min), ("MAX", F.max)]:
                aggs.append(f(c).cast("double").alias(f"{c}|{name}"))
        wide = rows.agg(*aggs)
        items = [
            F.struct(F.lit(n.split("|")[0]).alias("column"), F.lit(n.split("|")[1]).alias("agg"), F.col(f"`{n}`").alias("value"))
            for n in wide.columns
        ]
        out.append(wide.select(F.lit(label).alias("table"), F.explode(F.array(*items)).alias("x")).select("table", "x.*"))
    return reduce(DataFrame.unionByName, out)


def answered_aggregates(questions: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Resolve every aggregate question and look its value up."""
    resolved = qf.resolved_aggregates(questions, {n: numeric_columns(r) for n, r in tables.items()})
    return resolved.join(F.broadcast(all_aggregates(tables)), ["table", "column", "agg"])
