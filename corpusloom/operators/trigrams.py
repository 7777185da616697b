"""A stored trigram index of the text of many tables: substring search for terms of any kind, in one plan for all tables.

Rows of all tables are numbered and cut into blocks.  A trigram of a column has
one row per block with the positions that hold it.  A term of three characters or
more is found by intersecting the positions of its rarest trigrams block by
block, and what is left is verified with the text itself.  A shorter term is the
union of the trigrams that contain it; texts end with two marks, so that every
character is in some trigram.  Terms need no letter or digit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.operators.ordering import balanced
from corpusloom.operators.sizing import best, cut_lineage, distinct_sets, hinted, small
from corpusloom.operators.tables import Searchable, list_matches
from corpusloom.settings import DEFAULTS

BLOCK = 1024
RAREST = 3
END = "\u0000\u0000"


def grams(text: Column, n: int = 3) -> Column:
    """Distinct substrings of n characters."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n))))).otherwise(
        F.array().cast("array<string>"))


def save_tables(tables: list[Searchable], folder: str, block_rows: int = BLOCK) -> None:
    """Write ``texts`` (n, table, row_id, texts), ``grams`` (gram, slot, block, rows) and ``sizes`` (gram, size)."""
    rows = reduce(DataFrame.unionByName, [
        t.rows.select(F.lit(t.label).alias("table"), F.col(t.key).cast("string").alias("row_id"),
                      F.array(*[F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in t.text_columns]).alias("texts"))
        for t in tables])
    numbered = balanced(rows, ["table", "row_id"], "n", 64 * block_rows)
    numbered.write.mode("overwrite").parquet(f"{folder}/texts")
    stored = rows.sparkSession.read.parquet(f"{folder}/texts")
    each = stored.select("n", F.posexplode("texts").alias("slot", "text")).filter(F.col("text") != "")
    met = each.select(F.floor(F.col("n") / block_rows).alias("block"), (F.col("n") % block_rows).cast("int").alias("row"), "slot",
                      F.explode(grams(F.concat("text", F.lit(END)))).alias("gram"))
    lists = met.groupBy("gram", "slot", "block").agg(F.sort_array(F.collect_list("row")).alias("rows"))  # block_rows at most
    # readers look for few trigrams, so the files are in their order
    lists.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.mode("overwrite").parquet(f"{folder}/grams")
    rows.sparkSession.read.parquet(f"{folder}/grams").groupBy("gram").agg(F.sum(F.size("rows")).alias("size")).write.mode("overwrite").parquet(f"{folder}/sizes")


def matches(spark: SparkSession, folder: str, terms: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """(term, n, slot): every text that contains a term of ``terms`` (term), lower case."""
    postings, sizes, texts = (spark.read.parquet(f"{folder}/{name}") for name in ("grams", "sizes", "texts"))
    terms = cut_lineage(terms.select("term").filter(F.col("term") != "").distinct())
    parts = terms.filter(F.length("term") >= 3).select("term", grams(F.col("term")).alias("parts"))
    known = parts.select("term", F.size("parts").alias("n_parts"), F.explode("parts").alias("gram")).join(sizes, "gram")
    # a term with a trigram that no text has is in no text
    whole = known.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.max("n_parts").alias("n_parts")).filter("n = n_parts").select("term")
    rare = best(known.join(small(whole), "term"), ["term"], [F.asc("size"), F.asc("gram")], RAREST, "place")
    chosen = small(rare.select("term", "gram", F.least("n_parts", F.lit(RAREST)).alias("wanted")))
    long = (
        postings.join(chosen, "gram").groupBy("term", "slot", "block").agg(F.collect_list("rows").alias("lists"), F.max("wanted").alias("wanted"))
        .filter(F.size("lists") == F.col("wanted"))
        .select("term", "slot", "block", F.explode(F.aggregate(F.slice("lists", F.lit(2), F.size("lists")), F.col("lists")[0], F.array_intersect)).alias("row"))
        .select("term", "slot", (F.col("block") * block_rows + F.col("row")).alias("n"))
    )
    verified = texts.select("n", "texts").join(small(long), "n").filter(F.col("texts")[F.col("slot")].contains(F.col("term"))).select("term", "n", "slot")
    brief = terms.filter(F.length("term") < 3)
    within = sizes.select("gram", F.explode(F.array_distinct(F.concat(grams(F.col("gram"), 1), grams(F.col("gram"), 2)))).alias("term")).join(small(brief), "term")
    short = postings.join(small(within), "gram").groupBy("term", "slot", "block").agg(
        F.array_distinct(F.flatten(F.collect_list("rows"))).alias("rows")).select("term", "slot", "block", F.explode("rows").alias("row"))  # block_rows at most
    return verified.unionByName(short.select("term", (F.col("block") * block_rows + F.col("row")).alias("n"), "slot"))


def search_indexed(questions: DataFrame, folder: str, limit: int = DEFAULTS.table_hit_limit, block_rows: int = BLOCK) -> DataFrame:
    """questions (question_id, terms, phrases) to (question_id, table, row_id, score): the best rows per question and table.

    One point per different term and column, ten per phrase and column; equal scores go by row id, shorter ones first.
    """
    spark = questions.sparkSession

    def lower(c: str) -> Column:
        """The different terms of a row; those of a question that comes in several rows count several times."""
        none = F.array().cast("array<string>")
        each = F.filter(F.array_distinct(F.transform(F.coalesce(F.col(c), none), lambda t: F.lower(t))), lambda t: t != "")
        return F.sort_array(F.flatten(F.collect_list(each))).alias(c)

    owners, sets = distinct_sets(questions.groupBy("question_id").agg(lower("terms"), lower("phrases")), ["terms", "phrases"])

    def all_of(c: str, points: int) -> Column:
        return F.transform(c, lambda t: F.lit(points).cast("long"))

    asked = sets.select("set_id", F.concat("terms", "phrases").alias("patterns"), F.concat(all_of("terms", 1), all_of("phrases", 10)).alias("weights"), F.lit(None).cast("long").alias("need"))
    # a row with its terms meets the questions in one place; pairs of rows and questions are no rows
    met = matches(spark, folder, asked.select(F.explode("patterns").alias("term")), block_rows)
    met = met.groupBy("n").agg(F.collect_list("term").alias("found"))
    rows = met.join(spark.read.parquet(f"{folder}/texts").select("n", "table", "row_id"), "n")
    order = [F.desc("score"), F.asc(F.length("row_id")), F.asc("row_id")]
    found = cut_lineage(best(list_matches(rows, asked, limit), ["set_id", "table"], order, limit).drop("rank"))
    return best(found.join(hinted(owners), "set_id"), ["question_id", "table"], order, limit).select("question_id", "table", "row_id", "score")
