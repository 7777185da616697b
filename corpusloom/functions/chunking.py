"""Recursive splitting of texts into chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusloom import lexicon
from corpusloom.functions import kernels
from corpusloom.settings import DEFAULTS


def split_column(
    c: Column, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap, separators=None
) -> Column:
    ladder = list(separators or lexicon.SEPARATORS_DOCUMENT)

    def body(texts: pd.Series) -> pd.Series:
        return kernels.split_texts(texts, size, overlap, ladder)

    return F.pandas_udf(body, T.ArrayType(T.StringType()))(c)


def chunk_lists(
    documents: DataFrame, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap, separators=None,
    text: str = "text", out: str = "chunks",
) -> DataFrame:
    """The documents with the list of their chunks."""
    return documents.filter(F.trim(text) != "").withColumn(out, split_column(F.col(text), size, overlap, separators))


def chunks_of(
    documents: DataFrame, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap, separators=None,
    text: str = "text",
) -> DataFrame:
    """One row per chunk with its number ``chunk_i``; all other columns pass through."""
    others = [c for c in documents.columns if c != text]
    return documents.filter(F.trim(text) != "").select(
        *others, F.posexplode(split_column(F.col(text), size, overlap, separators)).alias("chunk_i", text)
    )


def chunk_key(doc_id: Column, chunk_i: Column) -> Column:
    """Number of a chunk that sorts by document and place: room for a million chunks per document."""
    return doc_id * 1_000_000 + chunk_i
