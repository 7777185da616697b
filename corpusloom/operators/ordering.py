"""Running sums and row numbers that do not put a whole key into one task.

Rows carry an integer order column.  It is cut into fixed blocks; sums run
inside each block, and only one total per block is ordered along the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.operators.sizing import cut_lineage
from corpusloom.settings import DEFAULTS


def running_sum(
    df: DataFrame, keys: list[str], order: str, value: Column, out: str, block: int = DEFAULTS.order_block, tie: str | None = None
) -> DataFrame:
    """Add the running sum of ``value`` per key, up to and including each row; equal order values go by ``tie``.

    The order column is a whole number, or a timestamp, whose blocks are of as many seconds.
    """
    number = F.unix_seconds(order) if df.schema[order].dataType.typeName() == "timestamp" else F.col(order)
    if df.schema[order].dataType.typeName() == "timestamp_ntz":
        number = F.unix_seconds(F.col(order).cast("timestamp"))
    along_rows = [order] if tie is None else [order, tie]
    cut = df.withColumn("__block", F.floor(number / block)).withColumn("__value", value)
    totals = cut.groupBy(*keys, "__block").agg(F.sum("__value").alias("__total"))
    along = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "__block", F.coalesce(F.sum("__total").over(along), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*keys, "__block").orderBy(*along_rows).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.withColumn("__inner", F.sum("__value").over(within))
        .join(offsets, [*keys, "__block"])
        .withColumn(out, F.col("__before") + F.col("__inner"))
        .drop("__block", "__value", "__inner", "__before")
    )


def numbered(df: DataFrame, keys: list[str], order: str, out: str, block: int = DEFAULTS.order_block, tie: str | None = None) -> DataFrame:
    """Row number from 1 per key along the order column."""
    return running_sum(df, keys, order, F.lit(1), out, block, tie)


def balanced(df: DataFrame, order: list[str], out: str, rows_per_part: int = DEFAULTS.order_block) -> DataFrame:
    """Row number from 0 along the order columns over the whole frame, whatever the keys look like.

    Rows are cut into ranges of about equal numbers of rows; the place of a row
    in the input is the last key, so that equal keys are divided as well.  Only
    one count per range is ordered in one place.
    """
    placed = cut_lineage(df.withColumn("__place", F.monotonically_increasing_id()))
    parts = max(1, -(-placed.count() // rows_per_part))
    along = placed.repartitionByRange(parts, *order, "__place").sortWithinPartitions(*order, "__place").drop("__place")
    numbers = cut_lineage(along.withColumn("__id", F.monotonically_increasing_id()))  # the range in the upper bits, the row in the lower 33
    within, part = F.col("__id").bitwiseAND((1 << 33) - 1), F.shiftright("__id", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = numbers.groupBy(part.alias("__part")).count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    return (
        numbers.withColumn("__part", part).withColumn("__within", within)
        .join(F.broadcast(offsets), "__part")  # one row per range of rows_per_part rows
        .withColumn(out, F.col("__before") + F.col("__within"))
        .drop("__part", "__within", "__before", "__id")
    )
