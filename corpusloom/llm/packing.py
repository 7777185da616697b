"""Best-fit packing of token sequences by exact complements.

Lengths are at most the capacity, so what has to be planned is a count per
length, of a size that does not grow with the corpus.  The plan indexes single,
pair and triple sums of the lengths still available; for the longest piece left
it takes the one, two or three pieces that fill its gap exactly, as many times
as their counts allow.  What has no exact filling is placed best fit, longest
first, whole groups of equal pieces at a time.  The plan is a list of patterns;
a piece finds its place from its rank among the pieces of its length.

Rows: a null text is empty and gives the end id alone.  Repeated rows are
packed as often as they occur.  Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.llm.common import text_of, written

CAPACITY = 4096
END_ID = 1
ROWS = 1000
STOP = "\x1f"
# fixed values: the vocabulary's pattern for lower-case text of ASCII and Latin letters, and such text
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t\n\r\x0b\x0ca-zß-öø-ÿ0-9]+")
PLAIN = re.compile(r"[\x00-\x7FÀ-ÖØ-öø-ÿ]*\Z")

Pattern = tuple[int, list[tuple[int, int]]]  # times, [(length, copies)]


class WordIds:
    """Ids of texts as little-endian 32-bit bytes.

    The vocabulary drops white space and no token reaches across it.  Text of
    plain letters, digits and signs is cut into parts by the vocabulary's own
    pattern; a stop byte after every part stands for the end that its last token
    is marked with, so one call merges a whole text.  Other words, and those
    that may name a special token, go to the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        # such files write a byte as a printable character: itself, or the next one from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        special = {a["content"] for a in told["added_tokens"]}
        ranks = {  # ids are in the order of the merges, those of an end first
            bytes(byte[c] for c in t.removesuffix("</w>")) + STOP.encode() * t.endswith("</w>"): i
            for t, i in told["model"]["vocab"].items() if t not in special
        }
        self.merging = tiktoken.Encoding("parts", pat_str=f"[^{STOP}]+{STOP}", mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bool:
        return bool(PLAIN.match(text)) and "<|" not in text and STOP not in text

    def merged(self, text: str) -> bytes:
        parts = PARTS.findall(text.lower())
        return self.merging.encode_to_numpy(STOP.join(parts) + STOP).astype("<u4").tobytes() if parts else b""

    def of(self, texts: list[str]) -> list[bytes]:
        return [self.merged(t) if self.plain(t) else self.mixed(t) for t in texts]

    def mixed(self, text: str) -> bytes:
        runs = groupby(text.replace("\n", " ").replace("\t", " ").split(" "), self.plain)
        joined = ((plain, " ".join(words)) for plain, words in runs)
        return b"".join(self.merged(t) if plain else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for plain, t in joined)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece with its rank among the pieces of its length in this task."""
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint"
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, task, met = WordIds(tokenizer), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            out = []
            texts = batch.column("text")
            made = (x for k in range(0, batch.num_rows, ROWS) for x in ids.of(texts.slice(k, ROWS).to_pylist()))
            for doc, found in zip(batch.column("id").to_pylist(), made):
                whole = found + end
                for i, at in enumerate(range(0, len(whole), 4 * capacity)):
                    part = whole[at : at + 4 * capacity]
                    n = len(part) // 4
                    out.append((doc, i, at // 4, n, zlib.crc32(part), task, met[n]))
                    met[n] += 1
            columns = list(zip(*out)) or [()] * 7
            types = [pa.int32() if i in (1, 5) else pa.int64() for i in range(7)]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return docs.mapInArrow(run, schema)


def sums(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which totals a length of the one and a length of the other index make."""
    n = len(one)
    size = 1 << (2 * n - 1).bit_length()
    found = np.fft.irfft(np.fft.rfft(one, size) * np.fft.rfft(other, size), size)[:n]
    return found > 0.5


def exact_patterns(counts: np.ndarray) -> list[Pattern]:
    """Patterns that fill the capacity exactly; takes what they use out of ``counts`` (by length)."""
    capacity = len(counts) - 1
    out: list[Pattern] = []

    def take(lengths: list[int]) -> bool:
        need = Counter(lengths)
        times = min(int(counts[x]) // k for x, k in need.items())
        if not times:
            return False
        for x, k in need.items():
            counts[x] -= times * k
        out.append((times, sorted(need.items(), reverse=True)))
        return True

    if counts[capacity]:
        take([capacity])
    index: tuple = ()
    for head in range(capacity - 1, 0, -1):
        while counts[head]:
            live = counts > 0
            if not index or (live != index[0]).any():
                pairs = sums(live.astype(float), live.astype(float))
                index = (live, pairs, sums(pairs.astype(float), live.astype(float)))
            live, pairs, triples = index
            gap = capacity - head
            ones = np.flatnonzero(live[: gap + 1])[::-1]
            done = bool(live[gap]) and take([head, gap])
            if not done and pairs[gap]:
                first = ones[(ones * 2 >= gap) & live[gap - ones]]
                done = any(take([head, int(a), gap - int(a)]) for a in first)
            if not done and triples[gap]:
                for a in ones[pairs[gap - ones]]:
                    rest = gap - int(a)
                    second = ones[(ones <= min(a, rest)) & (ones * 2 >= rest)]
                    second = second[live[rest - second]]
                    if done := any(take([head, int(a), int(b), rest - int(b)]) for b in second[:8]):
                        break
            if not done:
                break
    return out


def best_fit_patterns(counts: np.ndarray) -> list[Pattern]:
    """Patterns for the remaining counts: longest first, each into the fullest sequences that still hold it."""
    capacity = len(counts) - 1
    open_: dict[int, list[list]] = {}  # by gap: [times, [(length, copies)]]
    gaps: list[int] = []
    done: list[Pattern] = []

    def put(gap: int, times: int, held: list[tuple[int, int]]) -> None:
        if not times:
            return
        if gap == 0:
            done.append((times, held))
            return
        if gap not in open_:
            open_[gap] = []
            insort(gaps, gap)
        open_[gap].append([times, held])

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                gap, times, held = capacity, -(-left // (capacity // length)), []
            else:
                gap = gaps[at]
                times, held = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap], gaps[at]
            copies = gap // length
            full = min(times, left // copies)
            put(gap - copies * length, full, [*held, (length, copies)])
            left, times = left - full * copies, times - full
            if times and left:  # fewer than fit into one more
                put(gap - left * length, 1, [*held, (length, left)])
                left, times = 0, times - 1
            if held:
                put(gap, times, held)
    return done + [(times, held) for groups in open_.values() for times, held in groups]


def packing_plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    by = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        by[length] = n
    return exact_patterns(by) + best_fit_patterns(by)


class Places:
    """Where the n-th piece of a length goes: ranges of ranks per (length, pattern)."""

    SHIFT = 1 << 44

    def __init__(self, plan: list[Pattern]):
        rows, used, sequence = [], Counter(), 0
        for times, held in plan:
            offset = 0
            for length, copies in held:
                rows.append((length * self.SHIFT + used[length], copies, sequence, offset, length))
                used[length] += times * copies
                offset += length * copies
            sequence += times
        self.keys, self.copies, self.sequence, self.offset, self.length = np.array(sorted(rows) or [(0, 1, 0, 0, 0)], np.int64).T
        self.sequences = sequence

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = length * self.SHIFT + rank
        i = np.searchsorted(self.keys, key, "right") - 1
        nth = key - self.keys[i]
        return self.sequence[i] + nth // self.copies[i], self.offset[i] + nth % self.copies[i] * self.length[i]


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_column: str = "doc_id",
           text_column: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(docs[id_column].cast("bigint").alias("id"), text_of(docs, text_column).alias("text"))
    cut = written(pieces(rows, tokenizer, capacity, end_id))
    per_task = written(cut.groupBy("task", "length").count())
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most one per length
    places = Places(packing_plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("task", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = cut.join(offsets, ["task", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.of(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.record_batch([*[batch.column(c) for c in kept], pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return ranked.select(*kept, "rank").mapInArrow(
        place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
