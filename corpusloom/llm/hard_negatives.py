"""Hard negatives of embedding anchors by bounds along a spanning tree of the anchors.

1. Anchors of one label are ordered by the signs of their components, cut into
   blocks, and each block gets a minimum spanning tree over the distances of its
   anchors.
2. Candidates are read where they lie, each task against the blocks of one
   broadcast slice of bounded bytes.  The root of a tree is scored against all
   candidates.  A child's score lies within the parent's plus or minus the
   length of the edge times the norm of the candidate; where the parent was not
   scored itself, its own uncertainty is added.  Only candidates whose interval
   meets the window of the child are scored exactly.
3. The first pass has the window from the worst positive kept so far upwards,
   over rows of the anchor's label.  The second one has the windows of the
   positives found, over rows of other labels.  A task gives out the few best per
   anchor and window; one row number per anchor ends each pass.

Scores are integers: products of floored multiples are exact in the number type
that the magnitudes allow, and bounds are widened by one half.

Rows: a null id, label or vector, or any null or non-finite component takes no
part.  Vectors of differing lengths are compared as if the shorter one ended in
zeros, so an empty vector scores 0.  Every row counts as often as it occurs;
an anchor repeated with label and vector is asked once, and a row with the
anchor's own id is never its positive.  Other columns are ignored.  Without
anchors, positives or negatives there are no rows.  Scores beyond 64 bits are an
error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.common import written
from corpusloom.llm.topk import LOW, Running
from corpusloom.operators.sizing import best

SCALE = 256
TREE = 512
CHUNK = 4096
SLICE_BYTES = 32 << 20
DENSE = 0.25


def valid_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and integer vectors (as doubles, padded with zeros) of the rows that take part."""
    vectors = batch.column("embedding")
    starts = vectors.offsets.to_numpy().astype(np.int64)
    flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)[starts[0] : starts[-1]]
    starts = starts - starts[0]
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    use = np.flatnonzero(bad[starts[1:]] == bad[starts[:-1]])
    sizes = np.diff(starts)
    wide = int(sizes[use].max()) if len(use) else 0
    made = np.zeros((len(use), wide))
    if len(use) and (sizes[use] == wide).all():
        made = flat[(starts[use][:, None] + np.arange(wide)).ravel()].reshape(len(use), wide)
    else:
        for i, row in enumerate(use):
            made[i, : sizes[row]] = flat[starts[row] : starts[row + 1]]
    ids, labels = (batch.column(c).to_numpy(zero_copy_only=False)[use] for c in ("vec_id", "label"))
    return ids, labels, np.floor(SCALE * made)


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent (-1 for the root) and edge length of every vector in a minimum spanning tree."""
    n = len(vectors)
    parent, length = np.full(n, -1, np.int32), np.zeros(n)
    near, who = np.full(n, np.inf), np.zeros(n, np.int32)
    left = np.ones(n, bool)
    now = 0
    for _ in range(n - 1):
        left[now] = False
        distance = np.sqrt(((vectors - vectors[now]) ** 2).sum(1))
        closer = left & (distance < near)
        near[closer], who[closer] = distance[closer], now
        now = int(np.argmin(np.where(left, near, np.inf)))
        parent[now], length[now] = who[now], near[now]
    return parent, length


def tree_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors sorted by label to blocks of one label with their tree."""
    task, made = TaskContext.get().partitionId(), 0
    held: list[tuple] = []

    def block(label: int, rows: list[tuple]) -> pa.RecordBatch:
        wide = max(len(v) for _, v in rows)
        mat = np.array([np.pad(v, (0, wide - len(v))) for _, v in rows]).reshape(len(rows), wide)
        parent, length = spanning_tree(mat)
        ids = np.array([i for i, _ in rows], np.int64)
        return pa.RecordBatch.from_pydict({
            "block": pa.array([(task << 32) + made], pa.int64()), "label": pa.array([label], pa.int64()), "n": pa.array([len(rows)], pa.int32()),
            **{k: pa.array([v.tobytes()], pa.binary()) for k, v in (("ids", ids), ("vectors", mat), ("parents", parent), ("edges", length))}})

    label = None
    for batch in batches:
        ids, labels, mat = valid_rows(batch)
        for i, own, vector in zip(ids.tolist(), labels.tolist(), mat):
            if held and (own != label or len(held) == TREE):
                yield block(label, held)
                made, held = made + 1, []
            label = own
            held.append((i, vector))
    if held:
        yield block(label, held)


BLOCKS = "block bigint, label bigint, n int, ids binary, vectors binary, parents binary, edges binary"


class Tree:
    """Anchors of one label; scores them against candidates from the root down."""

    def __init__(self, row: dict):
        n = row["n"]
        self.block, self.label, self.n = row["block"], row["label"], n
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(n, -1)
        self.parents, self.edges = np.frombuffer(row["parents"], np.int32), np.frombuffer(row["edges"], np.float64)
        self.most = float(np.abs(self.vectors).max(initial=0))
        depth, at = np.zeros(n, int), self.parents.copy()
        while (at >= 0).any():
            depth += at >= 0
            at = np.where(at >= 0, self.parents[at], -1)
        self.levels = [np.flatnonzero(depth == d) for d in range(depth.max(initial=0) + 1)]
        self.pairs = self.scored = 0  # of all pairs met, how many were scored exactly

    def scores(self, found: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """(anchors x candidates) exact scores of all pairs that may lie in [low, high]; LOW where that is ruled out."""
        wide = max(found.shape[1], self.vectors.shape[1])
        mine, theirs = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (self.vectors, found))
        largest = wide * max(self.most, 1.0) * max(float(np.abs(found).max(initial=0)), 1.0)
        if largest >= 2.0**62:
            raise ValueError("scores of these vectors exceed 64 bits")
        kind = np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else np.int64
        norms = np.sqrt((theirs * theirs).sum(1))
        slack = 0.5 if kind != np.int64 else 1 + 1e-12 * largest
        mine, theirs = mine.astype(kind), theirs.astype(kind)
        out = np.full((self.n, len(found)), LOW, np.float64 if kind != np.int64 else np.int64)
        center, spread = np.empty((self.n, len(found)), np.float64), np.zeros((self.n, len(found)), np.float64)
        for depth, level in enumerate(self.levels):
            if depth == 0:
                out[level] = center[level] = mine[level] @ theirs.T
                self.scored += out[level].size
                continue
            up = self.parents[level]
            around, reach = center[up], spread[up] + (self.edges[level] * (1 + 1e-9))[:, None] * norms
            open_ = (around + reach + slack >= low[level][:, None]) & (around - reach - slack <= high[level][:, None])
            full = open_.mean(1) > DENSE
            rows = level[full]
            if len(rows):
                exact = mine[rows] @ theirs.T
                around[full], reach[full] = exact, 0
                out[rows] = exact
            row, column = np.nonzero(open_ & ~full[:, None])
            if len(row):
                exact = np.einsum("ij,ij->i", mine[level[row]], theirs[column])
                around[row, column], reach[row, column] = exact, 0
                out[level[row], column] = exact
            center[level], spread[level] = around, reach
            self.scored += len(rows) * len(found) + len(row)
        self.pairs += out.size
        return out


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        ids, labels, vectors = valid_rows(batch)
        for k in range(0, len(ids), CHUNK):
            yield ids[k : k + CHUNK], labels[k : k + CHUNK], vectors[k : k + CHUNK]


def sliced(blocks: DataFrame, slice_bytes: int) -> list[tuple[int, int]]:
    """Ranges of block numbers of at most so many bytes each; one small row per block of anchors is read."""
    size = F.octet_length("vectors") + F.octet_length("ids") * 64
    out, used = [], 0
    for row in blocks.select("block", size.alias("size")).orderBy("block").collect():
        if not out or used + row["size"] > slice_bytes:
            out.append((row["block"], row["block"]))
            used = 0
        out[-1] = (out[-1][0], row["block"])
        used += row["size"]
    return out


def over_slices(rows: DataFrame, blocks: DataFrame, ranges: list[tuple[int, int]], work, schema: str) -> DataFrame:
    """``work(anchor rows, batches)`` over all candidates, once for each slice of anchors, whose bytes are bounded."""
    context = rows.sparkSession.sparkContext
    parts = []
    for low, high in ranges:
        held = context.broadcast([r.asDict(True) for r in blocks.filter(F.col("block").between(low, high)).collect()])
        parts.append(rows.mapInArrow(lambda batches, held=held: work(held.value, batches), schema))
    return reduce(DataFrame.unionByName, parts)


def positives_of(held: list[dict], batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    trees = [Tree(r) for r in held]
    kept = [Running(t.n, k) for t in trees]
    for ids, labels, vectors in chunks(batches):
        for tree, runs in zip(trees, kept):
            mine = labels == tree.label
            if not mine.any():
                continue
            scores = tree.scores(vectors[mine], runs.floor(), np.full(tree.n, np.inf))
            scores[tree.ids[:, None] == ids[mine]] = LOW
            runs.offer(scores, ids[mine])
    for tree, runs in zip(trees, kept):
        nth, other, score = runs.found()
        yield pa.RecordBatch.from_pydict({
            "block": pa.array(np.full(len(nth), tree.block)), "nth": pa.array(nth.astype(np.int32)), "anchor_id": pa.array(tree.ids[nth]),
            "positive_id": pa.array(other), "positive_score": pa.array(score)})


def negatives_of(held: list[dict], batches: Iterator[pa.RecordBatch], k: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    trees = [Tree(r) for r in held]
    windows = []
    for r, tree in zip(held, trees):
        places = max((p["place"] for p in r["positives"]), default=0)
        made = []
        for place in range(1, places + 1):
            bounds = np.tile([[np.inf], [-np.inf]], tree.n)
            ids, scores = np.zeros(tree.n, np.int64), np.zeros(tree.n, np.int64)
            for p in r["positives"]:
                if p["place"] == place:
                    s, i = p["positive_score"], p["nth"]
                    bounds[:, i] = -(-low * s // 100), high * s // 100
                    ids[i], scores[i] = p["positive_id"], s
            made.append((bounds, ids, scores, Running(tree.n, k)))
        windows.append(made)
    for ids, labels, vectors in chunks(batches):
        for tree, made in zip(trees, windows):
            other = labels != tree.label
            if not other.any() or not made:
                continue
            least = np.min([np.maximum(b[0], w.floor()) for b, _, _, w in made], axis=0)
            most = np.max([b[1] for b, _, _, _ in made], axis=0)
            scores = tree.scores(vectors[other], least, most)
            for bounds, _, _, runs in made:
                runs.offer(np.where((scores >= bounds[0][:, None]) & (scores <= bounds[1][:, None]), scores, LOW), ids[other])
    for tree, made in zip(trees, windows):
        for place, (_, positive, score, runs) in enumerate(made, 1):
            nth, other, found = runs.found()
            yield pa.RecordBatch.from_pydict({
                "block": pa.array(np.full(len(nth), tree.block)), "nth": pa.array(nth.astype(np.int32)),
                "place": pa.array(np.full(len(nth), place, np.int32)), "anchor_id": pa.array(tree.ids[nth]),
                "positive_id": pa.array(positive[nth]), "positive_score": pa.array(score[nth]),
                "negative_id": pa.array(other), "negative_score": pa.array(found)})


def hard_negatives(table: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, every: int = 100,
                   slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors whose id is divisible by ``every``.

    ``table`` has (vec_id, label, embedding).  A negative's score lies between
    ``low`` and ``high`` hundredths of the positive's.
    """
    rows = table.select(
        table["vec_id"].cast("bigint").alias("vec_id"), table["label"].cast("bigint").alias("label"), table["embedding"].alias("embedding")
    ).dropna()
    signs = F.aggregate(F.slice("embedding", 1, 24), F.lit(0).cast("bigint"), lambda a, x: 2 * a + F.coalesce(x > 0, F.lit(False)).cast("bigint"))
    anchors = rows.filter(F.col("vec_id") % every == 0).distinct().withColumn("code", signs)
    n = max(1, -(-rows.filter(F.col("vec_id") % every == 0).count() // TREE))
    order = ["label", "code", "vec_id"]
    blocks = written(anchors.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(tree_blocks, BLOCKS))
    ranges = sliced(blocks, slice_bytes)
    spark = table.sparkSession
    shape = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not ranges:
        return spark.createDataFrame([], shape)
    near = over_slices(rows, blocks, ranges, lambda held, batches: positives_of(held, batches, positives),
                       "block bigint, nth int, anchor_id bigint, positive_id bigint, positive_score bigint")
    near = written(best(near, ["block", "nth"], [F.desc("positive_score"), F.asc("positive_id")], positives, "place"))
    asked = near.groupBy("block").agg(F.collect_list(F.struct("nth", "place", "positive_id", "positive_score")).alias("positives"))  # TREE x positives at most
    far = over_slices(rows, blocks.join(asked, "block"), ranges, lambda held, batches: negatives_of(held, batches, negatives, low, high),
                      "block bigint, nth int, place int, anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    top = best(far, ["block", "nth", "place"], [F.desc("negative_score"), F.asc("negative_id")], negatives)
    return top.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def with_relabelled(table: DataFrame, step: int = 7, labels: int = 10) -> DataFrame:
    """Labels of ids divisible by ``step`` moved on by one, which makes some neighbours wrong on purpose."""
    moved = F.when(table["vec_id"] % step == 0, (table["label"] + 1) % labels).otherwise(table["label"])
    return table.select(table["vec_id"].alias("vec_id"), moved.alias("label"), table["embedding"].alias("embedding"))
