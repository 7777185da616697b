"""Ranked lexical search for many items at once, where items share the work of terms they have in common.

1. Items become (item, term, times) rows; they are cut into slices of a bounded
   number of rows, and each slice is one search over all documents.
2. Documents are cut into terms where they lie; their length and the counts of the
   slice's terms are written, and from them the statistics of the whole table.
3. Term sets that items share are mined: the terms of each item are put in order
   of how many items hold them, and neighbours that occur together in several
   items become one node, then pairs of such nodes, until nothing is shared.  The
   result is a directed graph whose leaves are terms and whose upper nodes are
   shared sets.
4. For a block of documents every leaf and every shared set gets its partial
   score per document once, level by level, and an item's scores are the sum of the
   few nodes left of it.  A task keeps the best documents per item while it reads; the
   kept ones meet in one row number per item.

Rows: a null text has no terms; a document without terms counts in no statistic
and is never found.  Repeated documents are documents of their own; a null id is
the last of equal scores.  Rows of ``items`` with one id and one text count once,
and different texts under one id are one item with the terms of all; an item
without terms gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm.common import written
from corpusloom.llm.topk import NULL_ID, Running
from corpusloom.operators.sizing import best

SLICE_TERMS = 200_000
BLOCK_BYTES = 32 << 20
# digits, letters and everything beyond ASCII are parts of terms, A-Z in lower case; other signs part them
PARTED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(PARTED).split()


def asked_terms(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(item, term, times) of all items."""
    rows = items.select(items[id_column].alias("item"), items[text_column].cast("string").cast("binary").alias("text")).distinct()
    kind = to_arrow_type(rows.schema["item"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item"), batch.column("text").to_pylist()):
                counts = Counter(terms_of(text or b""))
                yield pa.RecordBatch.from_pydict({
                    "item": pa.array([item.as_py()] * len(counts), kind), "term": pa.array(list(counts), pa.binary()), "times": pa.array(list(counts.values()), pa.int64())})

    shape = f"item {rows.schema['item'].dataType.simpleString()}, term binary, times bigint"
    return rows.mapInArrow(run, shape).groupBy("item", "term").agg(F.sum("times").alias("times"))


# shared term sets -------------------------------------------------------------------------------


@dataclass
class Sharing:
    """Leaves are (term, times); node ``len(leaves) + j`` is the sum of the two nodes of ``pairs[j]``; levels end at ``ends``."""

    terms: list[bytes]
    leaf_term: np.ndarray
    leaf_times: np.ndarray
    pairs: np.ndarray
    ends: list[int]
    items: list[list[int]]

    @property
    def size(self) -> int:
        return len(self.leaf_term) + len(self.pairs)


def shared_sets(items: list[list[tuple[bytes, int]]]) -> Sharing:
    """Mine what items share.  Every level pairs neighbours that occur together in several items."""
    holders: dict[tuple[bytes, int], list[int]] = {}
    for i, terms in enumerate(items):
        for leaf in terms:
            holders.setdefault(leaf, []).append(i)
    # leaves of the same items stand together, the most shared ones first
    leaves = sorted(holders, key=lambda x: (-len(holders[x]), holders[x], x))
    number = {leaf: k for k, leaf in enumerate(leaves)}
    terms = sorted({t for t, _ in leaves})
    code = {t: k for k, t in enumerate(terms)}
    held = [sorted(number[x] for x in set(row)) for row in items]
    pairs, ends, total = [], [], len(leaves)
    while True:
        met = Counter(p for row in held for p in zip(row, row[1:]))
        made: dict[tuple[int, int], int] = {}
        for i, row in enumerate(held):
            out, k = [], 0
            while k < len(row):
                here = met[row[k], row[k + 1]] if k + 1 < len(row) else 0
                after = met[row[k + 1], row[k + 2]] if k + 2 < len(row) else 0
                if here > 1 and here >= after:
                    node = made.setdefault((row[k], row[k + 1]), total + len(pairs) + len(made))
                    out.append(node)
                    k += 2
                else:
                    out.append(row[k])
                    k += 1
            held[i] = out
        if not made:
            break
        pairs.extend(made)
        ends.append(len(pairs))
    return Sharing(terms, np.array([code[t] for t, _ in leaves], np.int64), np.array([n for _, n in leaves], np.int64),
                   np.array(pairs, np.int64).reshape(-1, 2), ends, held)


def item_scores(sharing: Sharing, of_term: np.ndarray) -> np.ndarray:
    """(items x documents) from the scores of single terms (terms x documents); every shared set is added up once."""
    leaves = len(sharing.leaf_term)
    made = np.empty((sharing.size, of_term.shape[1]), np.int64)
    np.multiply(of_term[sharing.leaf_term], sharing.leaf_times[:, None], out=made[:leaves])
    start = 0
    for end in sharing.ends:
        one, other = sharing.pairs[start:end].T
        np.add(made[one], made[other], out=made[leaves + start : leaves + end])
        start = end
    out = np.zeros((len(sharing.items), of_term.shape[1]), np.int64)
    for i, nodes in enumerate(sharing.items):
        out[i] = made[nodes].sum(axis=0)
    return out


# documents --------------------------------------------------------------------------------------


def counted(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(id, n, codes, counts) of documents with terms: all terms and, of the given ones, their counts."""
    held = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = held.value.get
        for batch in batches:
            ids, sizes, codes, counts = [], [], [], []
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                terms = terms_of(text or b"")
                if not terms:
                    continue
                found = Counter(map(code, terms))
                found.pop(None, None)
                ids.append(doc)
                sizes.append(len(terms))
                codes.append(np.fromiter(found, "<u4", len(found)).tobytes())
                counts.append(np.fromiter(found.values(), "<u4", len(found)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(codes, pa.binary()), pa.array(counts, pa.binary())], names=["id", "n", "codes", "counts"])

    return docs.mapInArrow(run, "id bigint, n bigint, codes binary, counts binary")


def document_frequencies(postings: DataFrame, terms: int) -> np.ndarray:
    """Documents per term, added up in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("codes").to_pylist()), "<u4"), minlength=terms)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"code": pa.array(met, pa.int64()), "df": pa.array(total[met])})

    out = np.zeros(terms, np.int64)
    for row in postings.select("codes").mapInArrow(run, "code bigint, df bigint").groupBy("code").agg(F.sum("df").alias("df")).collect():  # a row per term of the slice
        out[row["code"]] = row["df"]
    return out


def best_of_slice(postings: DataFrame, sharing: Sharing, weights: np.ndarray, n_docs: int, n_terms: int, k: int, names: list, kind) -> DataFrame:
    """(item, doc, score): the k best documents of each item in every task."""
    held = postings.sparkSession.sparkContext.broadcast((sharing, weights, names))
    item_type = to_arrow_type(kind)
    step = max(1, BLOCK_BYTES // (8 * (sharing.size + len(sharing.terms) + len(sharing.items))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sharing, weights, names = held.value
        kept = Running(len(sharing.items), k)
        for batch in batches:
            ids = batch.column("id").fill_null(NULL_ID).to_numpy()
            order = np.argsort(ids, kind="stable")
            sizes = batch.column("n").to_numpy()
            codes, counts = (batch.column(c).to_pylist() for c in ("codes", "counts"))
            for at in range(0, len(order), step):
                some = order[at : at + step]
                where = np.repeat(np.arange(len(some)), [len(codes[i]) // 4 for i in some])
                code = np.frombuffer(b"".join(codes[i] for i in some), "<u4").astype(np.int64)
                tf = np.frombuffer(b"".join(counts[i] for i in some), "<u4").astype(np.int64)
                mass = 75 + 25 * sizes[some] * n_docs // n_terms
                of_term = np.zeros((len(sharing.terms), len(some)), np.int64)
                of_term[code, where] = weights[code] * (1_000_000_000 * tf // (1000 * tf + 12 * mass[where]))
                scores = item_scores(sharing, of_term)
                scores[scores <= 0] = -(1 << 62)
                kept.offer(scores, ids[some])
        row, doc, score = kept.found()
        yield pa.RecordBatch.from_pydict({
            "item": pa.array([names[i] for i in row.tolist()], item_type), "doc": pa.array(doc, mask=doc == NULL_ID), "score": pa.array(score)})

    return postings.mapInArrow(run, f"item {kind.simpleString()}, doc bigint, score bigint")


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 20, id_column: str = "doc_id", text_column: str = "text",
                     item_column: str = "item_id", item_text: str = "text", slice_terms: int = SLICE_TERMS) -> DataFrame:
    """(item, rank, doc, score): the k best documents of every item, best first, equal scores by document."""
    asked = written(asked_terms(items, item_column, item_text))
    kind = asked.schema["item"].dataType
    n_slices = -(-asked.count() // slice_terms)
    rows = docs.select(docs[id_column].cast("bigint").alias("id"), docs[text_column].cast("string").cast("binary").alias("text"))
    parts = []
    for nth in range(n_slices):
        found: dict = {}
        for r in asked.filter(F.pmod(F.xxhash64("item"), F.lit(n_slices)) == nth).collect():  # slice_terms rows or so
            found.setdefault(r["item"], []).append((bytes(r["term"]), r["times"]))
        if not found:
            continue
        sharing = shared_sets([sorted(x) for x in found.values()])
        postings = written(counted(rows, sharing.terms))
        n_docs, n_terms = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        frequency = document_frequencies(postings, len(sharing.terms))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in frequency.tolist()], np.int64)
        parts.append(best_of_slice(postings, sharing, weights, n_docs, n_terms, k, list(found), kind))
    shape = f"item {kind.simpleString()}, doc bigint, score bigint"
    every = reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], shape)
    top = best(every, ["item"], [F.desc("score"), F.asc_nulls_last("doc")], k)
    return top.select("item", F.col("rank").cast("int").alias("rank"), "doc", "score")
