"""Exact dedup by progressive refinement: byte length, then a hash of the head, then a hash of the whole text.

Each step only works on rows whose group still has several members, so the
whole content is hashed for surviving groups alone.  Counts are combined on the
map side; the result is joined back with hot groups split over tasks.

Rows: a null text counts as empty.  Of equal texts the row with the largest id
stays (nulls are lowest); of rows repeated with that id, one.  Columns of any
name may be carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.common import small, spread_join, text_of, written

HEAD = 64


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row: ``id``, ``keep_id``, ``group_size``, ``kept`` and the carried columns."""
    carried = {f"_c{i}": c for i, c in enumerate((carry or {}).values())}
    rows = docs.select(docs[id_column].alias("id"), text_of(docs, text_column).alias("text"), *[c.alias(n) for n, c in carried.items()])
    rows = rows.withColumn("bytes", F.octet_length("text"))
    head = F.xxhash64(F.substring("text", 1, HEAD))
    several = F.col("count") > 1
    lengths = written(rows.groupBy("bytes").count().filter(several).select("bytes"))
    alive = rows.join(small(lengths), "bytes", "left_semi").withColumn("head", head)
    heads = written(alive.groupBy("bytes", "head").count().filter(several).select("bytes", "head", F.lit(True).alias("alive")))
    marked = rows.withColumn("head", head).join(small(heads), ["bytes", "head"], "left")
    marks = written(marked.select(
        "id", *carried, F.when(F.col("alive"), F.sha2("text", 256)).alias("digest"), F.monotonically_increasing_id().alias("row")))
    best = F.max(F.struct("id", "row"))
    groups = marks.filter("digest is not null").groupBy("digest").agg(best.alias("best"), F.count("*").alias("size")).filter("size > 1")
    out = spread_join(marks, groups, "digest", F.xxhash64("row"))
    alone = F.col("size").isNull()
    return out.select(
        "id", F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"), F.coalesce("size", F.lit(1)).alias("group_size"),
        (alone | (F.col("row") == F.col("best.row"))).alias("kept"), *[F.col(n).alias(c) for n, c in zip(carried, carry or {})])
