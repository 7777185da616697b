"""Keyed tables in bucket folders: what a change touches, what it leaves, and the rows against the plain forms."""

import glob
import os
import time

from pyspark.sql import functions as F

from corpusloom.operators import upkeep
from corpusloom.sources import buckets

SHAPE = "k long, v string, created_at long, updated_at long"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is not None, r))


def files(folder):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/rows/*/*/*.parquet")}


def test_upsert_touches_only_the_buckets_of_its_keys(spark, tmp_path):
    place = str(tmp_path / "keyed")
    old = spark.createDataFrame([(i, f"v{i}", i, i) for i in range(200)] + [(None, "none", 1, 1)], SHAPE)
    new = spark.createDataFrame([(3, "late", 900, 900), (3, "later", 901, 901), (1000, "added", 902, 902), (None, "null", 903, 903), (7, "old", 0, 0)], SHAPE)
    buckets.save(old, place, "k", 32)
    before = files(place)
    time.sleep(0.05)
    # a key of a narrower type hashes to the same bucket
    touched = buckets.upsert(new.withColumn("k", F.col("k").cast("int")), place, ["v"])
    assert 0 < len(touched) <= 4
    after = files(place)
    assert all(after[f] == t for f, t in before.items())
    assert {int(f.split("stored_bucket=")[1].split("/")[0]) for f in after.keys() - before.keys()} == set(touched)
    assert rows_of(buckets.load(spark, place)) == rows_of(upkeep.upserted(old, new, "k", ["v"]))


def test_a_change_without_a_manifest_is_not_seen_and_reads_are_pruned(spark, tmp_path):
    place = str(tmp_path / "keyed")
    buckets.save(spark.range(300).select(F.col("id").alias("k"), F.lit("x").alias("v")), place, "k", 16)
    buckets._write(spark.createDataFrame([(1, "lost")], "k long, v string"), place, 1, "k", 16)
    assert buckets.load(spark, place).filter("v = 'lost'").count() == 0
    buckets.delete(spark.createDataFrame([(1,)], "k long"), place)
    assert buckets.load(spark, place).count() == 299
    some = buckets.load(spark, place, [5, 1])
    assert rows_of(some) == [(5, "x")]
    assert some.select(F.input_file_name().alias("f")).distinct().count() == 1
    assert buckets.load(spark, place, []).count() == 0


def test_children_empty_tables_and_emptied_buckets(spark, tmp_path):
    place = str(tmp_path / "keyed")
    old = spark.createDataFrame([(k, n) for k in (1, 2, None) for n in range(3)] + [(9, n) for n in range(2000)], "k int, n int")
    buckets.save(old, place, "k", 4)
    assert buckets.delete(old.limit(0), place) == []
    fresh = spark.createDataFrame([(2, 7), (5, 8)], "k int, n int")
    buckets.replace_children(fresh, place)
    assert rows_of(buckets.load(spark, place)) == rows_of(upkeep.children_replaced(old, fresh, "k"))
    buckets.delete(spark.createDataFrame([(k,) for k in (1, 2, 5, 9)], "k int"), place)
    assert rows_of(buckets.load(spark, place)) == [(None, 0), (None, 1), (None, 2)]
    empty = str(tmp_path / "empty")
    buckets.save(old.limit(0), empty, "k", 4)
    assert buckets.load(spark, empty).count() == 0
    buckets.replace_children(fresh, empty)
    assert rows_of(buckets.load(spark, empty)) == rows_of(fresh)
