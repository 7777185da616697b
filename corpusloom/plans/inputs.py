"""Frames that the registered queries derive from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.functions.vectors import hashed_vector
from corpusloom.plans.registry import Tables
from corpusloom.settings import DEFAULTS


def document_chunks(t: Tables, by_language: bool = False) -> DataFrame:
    collection = F.col("lang") if by_language else F.lit("all")
    return t.documents.select(
        collection.alias("collection"), F.col("doc_id").alias("chunk_id"), "text", "source"
    )


def benchmark_questions(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("question_id"), "text")


def with_hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("vec", hashed_vector(F.col("text"), DEFAULTS.vector_dim))


def part_questions(t: Tables) -> DataFrame:
    """One question per part, in ten phrasings chosen by the size of the part."""
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    forms = [
        ("Berapa harga ", name, "?"),
        ("Jelaskan tentang ", name, " dari file catalog_", F.col("p_brand")),
        ("Bandingkan ", name, " lebih murah mana vs ", F.col("p_type")),
        ("Siapa yang handle ", name, " di departemen IT atau Finance Manager"),
        ("Hitung total order dan jumlah stok ", name),
        ("Apa itu proses auction dan settlement ", name),
        ("Average price of product ", name, " by Project Manager and QA lead"),
        ("Tampilkan data karyawan Engineer ", name, " Rp 500.000 dan 5 juta sejak 12/03/2024 nomor ", size),
        ("Explain the conversation about ", name, " in notes_", size, ".txt email kontak"),
        (F.split_part(name, F.lit(" "), F.lit(2)), " ", size),
    ]
    text = F
    for i, form in enumerate(forms):
        made = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in form])
        text = text.when(F.col("p_size") % 10 == i, made)
    return t.part.select(F.col("p_partkey").alias("question_id"), text.alias("text"))
