"""Corpus files: text, pages of extracted documents, JSON, and an inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from corpusloom.functions.text import squeeze, strip

SUFFIXES = (".pdf", ".txt", ".md", ".log")


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """path, modificationTime, length and content of the files below a folder; only files of the suffixes are opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if suffixes:
        any_case = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in x) for x in suffixes]
        reader = reader.option("pathGlobFilter", "*{" + ",".join(any_case) + "}")
    return reader.load(folder)


def eligible(found: DataFrame, folder: str, suffixes=SUFFIXES, max_depth: int | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Files of a known suffix, not too deep, whose name contains none of the excluded parts."""
    path = F.col("path")
    kept = found.filter(suffix_of(path).isin(*suffixes))
    if max_depth is not None:
        base = folder.rstrip("/")
        below = F.substring(path, F.instr(path, base) + len(base) + 1, F.length(path))
        kept = kept.filter(F.size(F.split(below, "/")) <= max_depth)
    for part in exclude or []:
        kept = kept.filter(~F.lower(name_of(path)).contains(part.lower()))
    return kept


def text_documents(spark: SparkSession, folder: str, max_depth: int | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(source, doc_type, text) of text files: undecodable bytes are dropped, blank files too."""
    found = eligible(files(spark, folder, SUFFIXES[1:]), folder, SUFFIXES[1:], max_depth, exclude)
    text = strip(F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit("")))
    suffix = suffix_of(F.col("path"))
    kind = F.when(suffix == ".md", "markdown").when(suffix == ".log", "log").otherwise("txt")
    return found.select(F.col("path").alias("source"), kind.alias("doc_type"), text.alias("text")).filter(F.col("text") != "")


def extracted_pages(found: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(source, page, text): pages of binary documents by a user's extractor, blank pages dropped."""
    schema = T.StructType(
        [T.StructField("source", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType())]
    )

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [
                (path, n, page)
                for path, content in zip(frame["path"], frame["content"])
                for n, page in enumerate(extract(bytes(content)), 1)
            ]
            yield pd.DataFrame(rows, columns=["source", "page", "text"])

    pages = found.select("path", "content").mapInPandas(run, schema)
    return pages.withColumn("text", strip(squeeze(F.col("text")))).filter(F.col("text") != "")


def merged_pages(pages: DataFrame, key: str = "source", separator: str = "\n\n") -> DataFrame:
    """All pages of a file as one document."""
    return (
        pages.filter(F.trim("text") != "")
        .groupBy(key)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), separator).alias("text"))
    )


def json_documents(spark: SparkSession, folder: str) -> DataFrame:
    """JSON files as one text each, in compact form."""
    raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    return raw.select(
        F.col("_metadata.file_path").alias("source"), F.lit("json").alias("doc_type"),
        F.to_json(F.parse_json("value")).alias("text"),
    )


def csv_documents(spark: SparkSession, folder: str) -> DataFrame:
    """CSV files as one text each, as they are."""
    raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.[cC][sS][vV]")
    return raw.select(F.col("_metadata.file_path").alias("source"), F.lit("csv").alias("doc_type"), strip(F.col("value")).alias("text")).filter(F.col("text") != "")


def inventory(found: DataFrame) -> DataFrame:
    """Number and size of files (path, length) by suffix; files without one have an empty suffix."""
    return found.select(suffix_of(F.col("path")).alias("suffix"), "length").groupBy("suffix").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes")
    )
