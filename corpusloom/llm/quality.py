"""Quality classifier on random-indexing word vectors.

Every token (a run of letters and digits, or of other signs) and every token's
shape (character class and length) has a fixed random index vector of a few
+1 and -1.  A token's context vector is the sum of the index vectors of its
neighbours over the whole corpus; tokens share ``BUCKETS`` hashed rows, so the
table has the same size for any corpus.  Tasks add up their part and Spark adds
the rows.  A document is the mean of its tokens' vectors, scaled row by row to
unit length.  A two-layer network, fitted with numpy on at most ``SAMPLE``
labelled rows, gives log odds; a temperature fitted on rows left out of the
training turns them into probabilities.

Rows: a null or empty text has the zero vector and gets the network's answer to
it.  Repeated rows are scored each.  Several labels of one id are averaged;
null labels and labels without a document are left out.  Without labels of both
kinds every score is the share of label 1 (0.5 without any label).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from corpusloom.llm.common import small_batches, text_of, written
from corpusloom.llm.textkernel import LOWER, mix, pieces, span_hashes

BUCKETS = 1 << 13
DIM = 32
NONZERO = 4
SAMPLE = 30_000
HIDDEN = 32
EPOCHS = 40

# character classes: 0 blank, 1 small letter, 2 capital, 3 digit, 4 sign, 5 beyond ASCII
CLASS = np.full(256, 4, np.uint8)
CLASS[[32, *range(9, 14)]] = 0
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = 1, 2, 3, 5


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and shape bucket of each token, and for each row its first token."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = CLASS[data]
    group = np.where(kind == 0, 0, np.where(kind == 4, 2, 1))
    new = np.concatenate(([True], group[1:] != group[:-1]))
    edge = offsets[1:-1]
    new[edge[edge < len(data)]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(data))
    used = group[starts] > 0
    starts, ends = starts[used], ends[used]
    words = span_hashes(LOWER[data], starts, ends)
    has = [np.concatenate(([0], np.cumsum(kind == k))) for k in (1, 2, 3, 5)]
    shape = np.minimum(ends - starts, 15).astype(np.uint64) + np.uint64(16) * (kind[starts] == 4)
    for i, c in enumerate(has):
        shape += np.uint64(32 << i) * (c[ends] > c[starts])
    last = np.minimum(ends, len(data) - 1)
    shape += np.uint64(512) * ((group[last] == 2) & (ends < len(data)))  # a sign follows at once
    size = np.uint64(BUCKETS)
    return (words % size).astype(np.int64), (mix(shape + np.uint64(1 << 40)) % size).astype(np.int64), np.searchsorted(starts, offsets)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of every bucket's index vector."""
    seed = mix(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(1 << 50)).reshape(BUCKETS, NONZERO)
    return (seed % np.uint64(DIM)).astype(np.int64), np.where((seed >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)


def context_rows(texts: DataFrame) -> DataFrame:
    """(bucket, v0..): the part of the context vectors that each task has read."""
    names = ["bucket", *[f"v{i}" for i in range(DIM)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors()
        total = np.zeros(BUCKETS * DIM)

        def add(at: np.ndarray, near: np.ndarray) -> None:
            for k in range(NONZERO):
                total[:] += np.bincount(at * DIM + place[near, k], sign[near, k], BUCKETS * DIM)

        for batch in batches:
            for _, _, data, offsets in pieces(batch.column("text")):
                word, shape, first = tokens(data, offsets)
                beside = np.ones(max(len(word) - 1, 0), bool)
                inner = first[1:-1]
                beside[inner[(inner > 0) & (inner < len(word))] - 1] = False
                at = np.flatnonzero(beside)
                both = np.concatenate((at, at + 1)), np.concatenate((at + 1, at))
                add(word[both[0]], word[both[1]])
                add(shape[both[0]], shape[both[1]])
        table = total.reshape(BUCKETS, DIM)
        rows = np.flatnonzero(table.any(axis=1))
        yield pa.record_batch([pa.array(rows), *[pa.array(table[rows, i]) for i in range(DIM)]], names=names)

    return texts.select("text").mapInArrow(run, "bucket bigint, " + ", ".join(f"{n} double" for n in names[1:]))


def word_vectors(texts: DataFrame) -> np.ndarray:
    """The table of context vectors plus index vectors, rows of unit length: BUCKETS x DIM for any corpus."""
    names = [f"v{i}" for i in range(DIM)]
    with small_batches(texts.sparkSession):
        rows = context_rows(texts).groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    place, sign = index_vectors()
    own = np.zeros((BUCKETS, DIM))
    for k in range(NONZERO):
        own[np.arange(BUCKETS), place[:, k]] += sign[:, k]
    table = np.zeros((BUCKETS, DIM))
    table[rows["bucket"].to_numpy(np.int64)] = rows[names].to_numpy()
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return (unit(table) + unit(own)).astype(np.float32)


class Network:
    """Two layers with a temperature; ``fit`` is deterministic."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.share = float(y.mean()) if len(y) else 0.5
        self.fitted = len(set(y.tolist())) == 2
        if not self.fitted:
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-4
        order = rng.permutation(len(x))
        out, inside = order[: len(x) // 5], order[len(x) // 5 :]
        if len(set(y[inside].tolist())) < 2:
            inside = order
        z = (x - self.mean) / self.scale
        self.w = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w], 0
        for _ in range(epochs):
            rng.shuffle(inside)
            for at in range(0, len(inside), 256):
                some = inside[at : at + 256]
                step += 1
                h = np.tanh(z[some] @ self.w[0] + self.w[1])
                d = (1 / (1 + np.exp(-(h @ self.w[2] + self.w[3]))) - y[some]) / len(some)
                back = np.outer(d, self.w[2]) * (1 - h * h)
                for i, g in enumerate((z[some].T @ back, back.sum(0), h.T @ d, d.sum(keepdims=True))):
                    g = g + 1e-4 * self.w[i]
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - 0.005 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        odds, truth = self.odds(x[out]), y[out]
        heats = np.geomspace(0.25, 8, 41)
        loss = [np.logaddexp(0, np.where(truth == 1, -odds, odds) / t).mean() if len(out) else abs(t - 1) for t in heats]
        self.heat = float(heats[int(np.argmin(loss))])

    def odds(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.odds(x) / self.heat)) if self.fitted else np.full(len(x), self.share)


def held_out(doc: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc.cast("string")), F.lit(3)) == 1, F.lit(False))


def features(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean vector of the tokens, then of their shapes, for each text."""
    out = np.zeros((len(column), 2 * DIM), np.float32)
    for row, _, data, offsets in pieces(column):
        word, shape, first = tokens(data, offsets)
        n = np.diff(first)
        some = np.flatnonzero(n)
        if len(some):
            for k, ids in enumerate((word, shape)):
                sums = np.add.reduceat(vectors[ids], first[:-1][some])
                out[row + some, k * DIM : (k + 1) * DIM] = sums / n[some, None]
    return out


def pooled(texts: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(id, features) of rows of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = features(batch.column("text"), vectors)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, 2 * DIM, dtype=np.int32)), pa.array(out.ravel()))
            yield pa.record_batch([batch.column("id"), flat], names=["id", "features"])

    return texts.mapInArrow(run, "id bigint, features array<float>")


def fitted(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality",
           sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors of all texts, and the network fitted on labelled rows that are not held out."""
    doc = docs[id_column].cast("bigint")
    texts = docs.select(doc.alias("id"), text_of(docs, text_column).alias("text"))
    vectors = word_vectors(texts)
    known = labels.groupBy(labels[id_column].cast("bigint").alias("id")).agg(F.avg(labels[label_column]).alias("y")).filter("y is not null and id is not null")
    known = written(known.filter(~held_out(F.col("id"))).orderBy(F.xxhash64("id")).limit(sample))
    rows = pooled(texts.join(F.broadcast(known.select("id")), "id", "left_semi"), vectors)
    with small_batches(docs.sparkSession):
        rows = rows.join(known, "id").orderBy("id", F.xxhash64("features")).limit(sample).toPandas()
    x = np.stack(rows["features"].to_numpy()).astype(float) if len(rows) else np.zeros((0, 2 * DIM))
    return vectors, Network(x, (rows["y"].to_numpy(float) >= 0.5).astype(float))


def with_scores(docs: DataFrame, vectors: np.ndarray, network: Network, text_column: str = "text", score: str = "score") -> DataFrame:
    """The rows with their score in one more column; it replaces one of that name."""
    docs = docs.drop(score)
    schema = StructType([*docs.schema.fields, StructField(score, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chance = network.probability(features(batch.column(text_column), vectors).astype(float))
            yield pa.record_batch([*batch.columns, pa.array(chance, pa.float64())], names=[*batch.schema.names, score])

    return docs.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality",
                   sample: int = SAMPLE) -> DataFrame:
    """(id, held_out, score) for every row."""
    vectors, network = fitted(docs, labels, id_column, text_column, label_column, sample)
    doc = docs[id_column].cast("bigint")
    texts = docs.select(doc.alias("id"), held_out(doc).alias("held_out"), text_of(docs, text_column).alias("text"))
    kept = StructType([f for f in texts.schema.fields if f.name != "text"] + [StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chance = network.probability(features(batch.column("text"), vectors).astype(float))
            yield pa.record_batch([batch.column("id"), batch.column("held_out"), pa.array(chance, pa.float64())], names=["id", "held_out", "score"])

    return texts.mapInArrow(run, kept)
