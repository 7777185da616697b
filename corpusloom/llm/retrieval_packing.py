"""Packing of related documents into token sequences: lexical neighbours of a seed fill its window.

1. Documents become token ids, which are written once, with a sketch of each
   document: the least hash of its neighbouring ids.
2. The index terms are the ids themselves.  Their document frequencies over all
   documents, at most one per id of the vocabulary, and the mean length make the
   BM25 weights.
3. Rows are ordered by sketch over range partitions, so that like documents meet
   and a sketch that very many share is divided by row.  A task reads its rows as
   shards of bounded tokens and documents, each with an inverted index.
4. The first unused document of a shard is a seed.  It is placed, and its
   best-scored unused neighbours follow until the window is full; the last one is
   cut there, and its rest is the next seed.  When no neighbour shares a term, the
   next documents in order follow.
5. Only the last window of a task can stay open.  It is cut into sequences whose
   lengths are powers of two, so no sequence needs padding.

Rows: a null text is empty and gives the end id alone.  Repeated rows, and rows
with a null id, are packed as often as they occur.  Other columns are ignored.  No rows give no
sequences.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.common import text_of, written

CAPACITY = 2048
END_ID = 1
QUERY_TERMS = 32  # of a seed's terms, those with the largest weights ask for neighbours
SHARD_TOKENS = 2_000_000
SHARD_DOCS = 4096
TASK_TOKENS = 16_000_000
K1, B = 1.2, 0.75
MIX = np.uint64(0x9E3779B97F4A7C15)


def encoder(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary of a tokenizer file; merges are in order of their ids."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    # such files write a byte as a printable character: itself, or the next one from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {a["content"]: a["id"] for a in told.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def sketch(ids: np.ndarray) -> int:
    """The least hash of two neighbouring ids, as a signed number."""
    if len(ids) < 2:
        return int(ids[0]) if len(ids) else -1
    pairs = (ids[:-1].astype(np.uint64) << np.uint64(32)) + ids[1:]
    mixed = pairs * MIX
    mixed ^= mixed >> np.uint64(29)
    return int((mixed * MIX).min() >> np.uint64(1))


def tokenised(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(row, doc_id, key, n, ids): ids are compressed 16-bit (or, for larger vocabularies, 32-bit) numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pack = encoder(tokenizer), zstandard.ZstdCompressor(level=1).compress
        row = TaskContext.get().partitionId() << 33
        kind = "<u2" if encode.n_vocab <= 1 << 16 else "<u4"
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                ids = encode.encode_to_numpy(text.as_py(), allowed_special="all")
                out.append((row, doc, sketch(ids), len(ids) + 1, pack(np.append(ids, end_id).astype(kind).tobytes())))
                row += 1
            columns = list(zip(*out)) or [()] * 5
            types = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["row", "doc_id", "key", "n", "ids"])

    return docs.mapInArrow(run, "row bigint, doc_id bigint, key bigint, n bigint, ids binary")


def unpacked(data: bytes, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def term_weights(rows: DataFrame, n_docs: int) -> np.ndarray:
    """BM25 weight per id, from its documents in the whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for data, n in zip(batch.column("ids").to_pylist(), batch.column("n").to_pylist()):
                met = np.unique(unpacked(data, n)[:-1])
                if len(met) and met[-1] >= len(total):
                    total = np.pad(total, (0, int(met[-1]) + 1 - len(total)))
                total[met] += 1
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(met, pa.int64()), "df": pa.array(total[met])})

    counts = rows.select("ids", "n").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()  # one row per id of the vocabulary at most
    df = np.zeros(max((r["term"] for r in counts), default=0) + 1)
    for r in counts:
        df[r["term"]] = r["df"]
    return np.log1p((n_docs - df + 0.5) / (df + 0.5))


class Shard:
    """An inverted index over the documents of one shard."""

    def __init__(self, texts: list[np.ndarray], weights: np.ndarray, mean: float):
        self.n = len(texts)
        found = [np.unique(t[:-1], return_counts=True) for t in texts]
        sizes = np.array([len(u) for u, _ in found])
        terms = np.concatenate([u for u, _ in found]).astype(np.int64)
        tf = np.concatenate([c for _, c in found])
        docs = np.repeat(np.arange(self.n), sizes)
        norm = K1 * (1 - B + B * np.array([len(t) for t in texts]) / mean)
        gain = weights[terms] * tf * (K1 + 1) / (tf + norm[docs])
        self.ends = np.cumsum(sizes)
        self.terms, self.gain = terms, gain  # by document
        order = np.argsort(terms, kind="stable")
        self.docs, self.gains = docs[order], gain[order]  # by term
        self.starts = np.searchsorted(terms[order], np.arange(len(weights) + 1))

    def neighbours(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share one of the seed's strongest terms, best first, then in order."""
        own = slice(self.ends[seed - 1] if seed else 0, self.ends[seed])
        terms, gain = self.terms[own], self.gain[own]
        if len(terms) > QUERY_TERMS:
            terms = terms[np.argpartition(-gain, QUERY_TERMS)[:QUERY_TERMS]]
        spans = [slice(self.starts[t], self.starts[t + 1]) for t in terms.tolist()]
        if not spans:
            return np.zeros(0, np.int64)
        score = np.bincount(np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.gains[s] for s in spans]), self.n)
        score[used] = 0
        met = np.flatnonzero(score)
        return met[np.argsort(-score[met], kind="stable")]


class Windows:
    """Windows of one task; an open one goes on with the next shard."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: list[tuple] = []  # (doc_id, ids, start, length)
        self.used = 0
        self.rows: list[tuple] = []

    def close(self) -> None:
        offset = 0
        for doc, ids, start, length in self.open:
            self.rows.append((doc, start, length, zlib.crc32(ids[start : start + length].astype("<u4").tobytes()), len(ids), self.next_id, offset))
            offset += length
        self.next_id += 1
        self.open, self.used = [], 0

    def place(self, doc, ids: np.ndarray, start: int = 0) -> int:
        """Put in what fits; gives where the rest starts."""
        length = min(self.capacity - self.used, len(ids) - start)
        self.open.append((doc, ids, start, length))
        self.used += length
        return start + length

    def fill(self, names: list, texts: list[np.ndarray], shard: Shard) -> None:
        used = np.zeros(len(texts), bool)
        following, seed = 0, None
        while True:
            # a whole seed, or the rest of a cut one, opens a window or goes on with the open one
            if seed is None:
                while following < len(texts) and used[following]:
                    following += 1
                if following == len(texts):
                    return
                seed = (following, 0)
            now, at = seed
            used[now] = True
            at = self.place(names[now], texts[now], at)
            seed = (now, at) if at < len(texts[now]) else None
            if self.used < self.capacity:
                for other in shard.neighbours(now, used).tolist():
                    used[other] = True
                    at = self.place(names[other], texts[other])
                    if self.used == self.capacity:
                        seed = (other, at) if at < len(texts[other]) else None
                        break
            if self.used == self.capacity:
                self.close()

    def finish(self) -> None:
        """Cut an open window into sequences of powers of two."""
        left, total = self.open, self.used
        if total == self.capacity:
            self.close()
            return
        for bit in reversed(range(total.bit_length())):
            if not total >> bit & 1:
                continue
            self.open, self.used = [], 0
            while self.used < 1 << bit:
                doc, ids, start, length = left.pop(0)
                some = min(length, (1 << bit) - self.used)
                self.open.append((doc, ids, start, some))
                self.used += some
                if some < length:
                    left.insert(0, (doc, ids, start + some, length - some))
            self.close()


def packed_with_neighbours(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_column: str = "doc_id",
                           text_column: str = "text", task_tokens: int = TASK_TOKENS, shard_tokens: int = SHARD_TOKENS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    rows = written(tokenised(docs.select(docs[id_column].cast("bigint").alias("id"), text_of(docs, text_column).alias("text")), tokenizer, end_id))
    n_docs, tokens = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights, mean = term_weights(rows, n_docs), max(1.0, tokens / max(1, n_docs))
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    parts = max(1, -(-tokens // task_tokens))
    along = rows.repartitionByRange(parts, "key", "row").sortWithinPartitions("key", "row").select("doc_id", "n", "ids")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(capacity, TaskContext.get().partitionId() << 40)

        def given() -> pa.RecordBatch:
            made, windows.rows = list(zip(*windows.rows)) or [()] * 7, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in made], names=columns)

        names, texts, held = [], [], 0
        for batch in batches:
            for doc, n, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids"))):
                if names and (held + n > shard_tokens or len(names) == shard_docs):
                    windows.fill(names, texts, Shard(texts, shared.value, mean))
                    yield given()
                    names, texts, held = [], [], 0
                names.append(doc)
                texts.append(unpacked(data, n))
                held += n
        if names:
            windows.fill(names, texts, Shard(texts, shared.value, mean))
        windows.finish()
        yield given()

    return along.mapInArrow(run, ", ".join(f"{c} bigint" for c in columns))
