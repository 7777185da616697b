"""Dictionaries of names and words that are frames of any size, looked up in texts all at once.

A dictionary is turned into an automaton that finds every entry in one pass over
a text, so the work does not grow with the number of entries, and neither does
the plan.  A dictionary larger than a broadcast may be is looked up slice by
slice; what each slice finds is kept with the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusloom.functions import kernels
from corpusloom.operators.ordering import balanced
from corpusloom.operators.sizing import cut_lineage, size_in_bytes, small
from corpusloom.settings import DEFAULTS, Settings

FOUND = T.ArrayType(T.StructType([T.StructField("nth", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("size", T.IntegerType())]))


def numbered_entries(dictionary: DataFrame, name: str = "name") -> DataFrame:
    """Entries with ``nth``, from 0: longer names first, equal lengths by name; empty and null names are left out, of equal names one row stays."""
    once = dictionary.filter(F.length(name) > 0).dropDuplicates([name]).withColumn("__short", -F.length(name))
    return cut_lineage(balanced(once, ["__short", name], "nth").drop("__short"))


def with_found(df: DataFrame, text: Column, entries: DataFrame, out: str = "found", name: str = "name", settings: Settings = DEFAULTS) -> DataFrame:
    """Adds every occurrence of an entry in the text, as it is written: array<struct<nth, at, size>> by place, longer ones first."""
    total = max(1, size_in_bytes(entries.select(name, "nth")))
    slices = -(-total // settings.broadcast_bytes)
    source, found = f"__{out}_text", []
    made = df.withColumn(source, text)
    context = df.sparkSession.sparkContext
    for k in range(slices):
        part = entries.filter(F.col("nth") % slices == k).select("nth", name).collect()  # broadcast_bytes at most
        held = context.broadcast([(r["nth"], r[name]) for r in part])
        found.append(f"__{out}_{k}")
        made = made.mapInArrow(kernels.occurrences(held, source, found[-1]), T.StructType([*made.schema.fields, T.StructField(found[-1], FOUND)]))
    every = F.array_sort(F.flatten(F.array(*found)), lambda a, b: F.when(a["at"] != b["at"], a["at"] - b["at"]).otherwise(b["size"] - a["size"]))
    return made.withColumn(out, every).drop(source, *found)


def entries_within(df: DataFrame, keys: list[str], text: Column, dictionary: DataFrame, name: str = "name", settings: Settings = DEFAULTS) -> DataFrame:
    """(keys.., columns of the dictionary): one row per text and entry that it contains."""
    entries = numbered_entries(dictionary, name)
    met = with_found(df.select(*keys, text.alias("__t")), F.col("__t"), entries, "__found", name, settings)
    each = met.select(*keys, F.explode(F.array_distinct(F.transform("__found", lambda x: x["nth"]))).alias("nth"))
    return each.join(small(entries, settings), "nth").drop("nth")


def _folded(c: Column) -> Column:
    """A-Z in lower case, every character in its place."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def masked_by(df: DataFrame, text: str, names: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Replace names (name, alias) of several words in a text column, whatever the case of A-Z.

    Longer names are replaced first, equal ones from the left, and nothing is
    replaced twice; an alias is not searched again.
    """
    several = names.filter(F.col("name").contains(" ")).select(_folded(F.col("name")).alias("name"), "alias")
    entries = numbered_entries(several)
    met = with_found(df, _folded(F.col(text)), entries, "__found", settings=settings)
    chosen = met.mapInArrow(kernels.longest_first("__found", "__cuts"), T.StructType([*met.schema.fields, T.StructField("__cuts", FOUND)]))
    # aliases come by key and only for rows that need any
    wanted = chosen.withColumn("__row", F.monotonically_increasing_id())
    wanted = cut_lineage(wanted)
    pieces = wanted.select("__row", F.explode("__cuts").alias("c")).select("__row", "c.*").join(small(entries, settings), "nth")
    aliases = pieces.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("at", "size", "alias"))).alias("__done"))
    joined = wanted.join(aliases, "__row", "left")
    t, done = F.col(text), F.col("__done")
    between = F.transform(done, lambda x, i: F.concat(
        F.substring(t, F.when(i == 0, 1).otherwise(F.get(done, i - 1)["at"] + F.get(done, i - 1)["size"] + 1), x["at"] - F.when(i == 0, 0).otherwise(F.get(done, i - 1)["at"] + F.get(done, i - 1)["size"])),
        x["alias"]))
    last = F.element_at(done, -1)
    rest = F.substring(t, last["at"] + last["size"] + 1, F.length(t))
    return joined.withColumn(text, F.when(done.isNull(), t).otherwise(F.concat(F.array_join(between, ""), rest))).drop("__row", "__found", "__cuts", "__done")


def pseudonym_by(df: DataFrame, raw: str, names: DataFrame, out: str, other: str = "Unknown", settings: Settings = DEFAULTS) -> DataFrame:
    """Adds the alias of the longest name (name, alias) that the text contains in lower case, else ``other``."""
    entries = numbered_entries(names.select(F.lower("name").alias("name"), "alias"))
    met = with_found(df, F.lower(F.trim(F.col(raw))), entries, "__found", settings=settings)
    first = met.withColumn("nth", F.array_min(F.transform("__found", lambda x: x["nth"]))).drop("__found")
    return first.join(small(entries.select("nth", F.col("alias").alias(out)), settings), "nth", "left").withColumn(out, F.coalesce(out, F.lit(other))).drop("nth")
