"""Repeated passages by suffix arrays.

A corpus has one suffix array too many for one machine, so equal substrings
are first brought together:

1. Every window of ``length`` bytes has an anchor, the substring of ``GRAM``
   bytes with the least hash in it; equal windows have equal anchors.  Anchors
   held by one text only are dropped.
2. The stretches of text around shared anchors go to a group: that of the first
   text holding the anchor.  For an anchor of more than ``HOT`` texts each of its
   windows is sent by its hash instead, so that its group is split by content;
   equal windows are answered where they are read, up to ``WINDOWS`` at a time.
3. In a group: suffix array and longest common prefixes by prefix doubling.
   Intervals of suffixes that share ``length`` bytes are the nodes of the
   common-prefix tree at that depth.  A byte goes if a node's window covers it
   and the node has an occurrence in a text with a smaller id.  A group of more
   than ``LARGEST`` bytes is read block by block; what no block could answer goes
   on by the hashes of its windows, which are compared as a sorted stream.
   ``repeat_groups`` scans the deeper nodes with a stack and gives out those
   whose occurrences differ in the byte before them: maximal repeats.

Equal texts are one text with the smallest id; the others go whole if they are
at least ``length`` bytes long.

Rows: a null text is empty.  Rows that share an id never remove each other's
bytes.  A null id counts as larger than any other.  All columns but id and text
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.common import small, text_of, written
from corpusloom.llm.jaccard_join import shared_signatures
from corpusloom.llm.textkernel import BYTE_VALUES, POWERS, distinct, mix, pieces, span_hashes

LENGTH = 50
GRAM = 24
HOT = 1000
BLOCK = 1 << 20
LARGEST = 4 << 20
WINDOWS = 1 << 20
LAST = (1 << 63) - 1


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over every ``width`` consecutive values, by doubling."""
    out, size = values, 1
    while size * 2 <= width:
        out, size = pick(out[:-size], out[size:]), size * 2
    rest = width - size
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors of all windows that lie within one row, their hashes, and the anchor hash of the window at each position."""
    n, width = len(data), length - GRAM + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    up, down = POWERS.first(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[:-1], out=sums[1:])
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    least = sliding(grams, width, np.minimum)
    inside = np.zeros(len(least) + 1, np.int64)
    long = np.diff(offsets) >= length
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - length + 1, -1)
    least[np.cumsum(inside)[:-1] <= 0] = 0
    pad = np.zeros(width - 1, np.uint64)
    most = sliding(np.concatenate((pad, least, pad)), width, np.maximum)
    at = np.flatnonzero(most == grams)
    return at, grams[at], least


def anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """(sig, node): anchor hash and text key, once per text and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys = batch.column("key").to_numpy()
            row = 0
            for first, end, data, offsets in pieces(batch.column("text")):
                at, hashes, _ = anchors(data, offsets, length)
                cut = np.searchsorted(at, offsets)
                sigs, nodes = [], []
                for i in range(end - first):
                    key = int(keys[first + i])
                    if cut[i] == cut[i + 1] or key in seen:
                        continue
                    seen.add(key)
                    mine = distinct(hashes[cut[i] : cut[i + 1]])
                    sigs.append(mine)
                    nodes.append(np.full(len(mine), key, np.int64))
                if sigs:
                    yield pa.record_batch([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(nodes))], names=["sig", "node"])

    return texts.select("key", "text").mapInArrow(run, "sig bigint, node bigint")


def packed_texts(texts: DataFrame) -> DataFrame:
    """(key, packed): each text compressed for the shuffle, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            keys, packed = [], []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    packed.append(squeeze.compress(text.as_buffer()))
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(packed, pa.binary())], names=["key", "packed"])

    return texts.select("key", "text").mapInArrow(run, "key bigint, packed binary")


def merged_windows(key: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, stop) of windows, those that touch as one span."""
    order = np.lexsort((start, key))
    key, start = key[order], start[order]
    new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (start[1:] > start[:-1] + length))))[: len(key)]
    return key[new], start[new], start[np.append(new[1:], len(key))[: len(new)] - 1] + length


def sent_windows(window: np.ndarray, doc: np.ndarray, key: np.ndarray, start: np.ndarray, length: int) -> list[tuple]:
    """Rows of ``stretches``: of equal windows those of the smallest doc, the others as spans to go."""
    order = np.lexsort((doc, window))
    window, doc, key, start = window[order], doc[order], key[order], start[order]
    new = np.concatenate(([True], window[1:] != window[:-1]))
    later = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = [(int(w), int(d), int(k), int(a), None, None) for w, d, k, a in zip(window[~later], doc[~later], key[~later], start[~later])]
    if later.any():
        out += [(int(k), LAST, int(k), int(a), int(b), None) for k, a, b in zip(*merged_windows(key[later], start[later], length))]
    return out


def stretches(rows: DataFrame, length: int) -> DataFrame:
    """(grp, doc, key, start, stop, part): text around shared anchors; without a part, a span that is already known to go, without a stop, a window by its hash.

    ``rows`` has key, doc (smallest id), packed, and the shared anchors as arrays.
    """
    schema = "grp bigint, doc bigint, key bigint, start int, stop int, part binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        last = None
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["grp", "doc", "key", "start", "stop", "part"])

        for batch in batches:
            out: list[tuple] = []
            windows, held = [], 0
            for key, doc, packed, sig, lead, hot in zip(*[batch.column(c) for c in ("key", "doc", "packed", "sig", "leader", "hot")]):
                key, doc = key.as_py(), doc.as_py()
                if key == last:
                    continue
                last = key
                data = np.frombuffer(open_.decompress(packed.as_py()), np.uint8)
                at, hashes, least = anchors(data, np.array([0, len(data)]), length)
                sig = np.array(sig.values.to_numpy()).view(np.uint64)
                order = np.argsort(sig)
                sig, lead = sig[order], lead.values.to_numpy()[order]
                hot = hot.values.to_numpy(zero_copy_only=False)[order]
                where = np.minimum(np.searchsorted(sig, hashes), len(sig) - 1)
                use = sig[where] == hashes
                at, hashes, where = at[use], hashes[use], where[use]
                starts, stops = np.maximum(at - (length - GRAM), 0), np.minimum(at + length, len(data))
                grp, alone = lead[where], hot[where]
                if alone.any():
                    begin = np.flatnonzero(np.isin(least, hashes[alone]))
                    window = span_hashes(data, begin, begin + length).view(np.int64)
                    windows.append((window, np.full(len(begin), doc, np.int64), np.full(len(begin), key, np.int64), begin))
                    held += len(begin)
                    if held > WINDOWS:
                        yield made(sent_windows(*map(np.concatenate, zip(*windows)), length))
                        windows, held = [], 0
                starts, stops, grp = starts[~alone], stops[~alone], grp[~alone]
                if len(starts):
                    new = np.flatnonzero(np.concatenate(([True], (grp[1:] != grp[:-1]) | (starts[1:] > stops[:-1]))))
                    ends = np.append(new[1:], len(starts)) - 1
                    for i, j in zip(new, ends):
                        out.append((int(grp[i]), doc, key, starts[i], stops[j], data[starts[i] : stops[j]].tobytes()))
            if windows:
                out += sent_windows(*map(np.concatenate, zip(*windows)), length)
            if out:
                yield made(out)

    return rows.mapInArrow(run, schema)


def ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks of keys, and the sorted order."""
    order = np.argsort(keys, kind="stable").astype(np.int32)
    keys = keys[order]
    out = np.empty(len(keys), np.int32)
    out[order] = np.cumsum(np.concatenate(([False], keys[1:] != keys[:-1])), dtype=np.int32)
    return out, order


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` (at least 8) bytes, common prefixes of neighbours up to there, and left bytes.

    Works on bytes, eight at a time to begin with, or on numbers.  What is past the end sorts first.
    """
    n, size = len(data), 8 if data.dtype == np.uint8 else 1
    key = data.copy()
    if size == 8:
        padded, key = np.concatenate((data, np.zeros(8, np.uint8))), np.zeros(n, np.uint64)
        for i in range(8):
            key <<= np.uint64(8)
            key |= padded[i : i + n]
    rank, order = ranks(key)
    known = {size: rank}
    while size < depth:
        step = min(size, depth - size)
        key = rank.astype(np.int64)
        key *= n + 1
        key[: max(0, n - step)] += rank[step:] + 1
        rank, order = ranks(key)
        size += step
        known[size] = rank
    del key
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), np.int32)
    for size in sorted(known, reverse=True):
        at, bt = a + common, b + common
        fits = (common + size <= depth) & (at < n) & (bt < n)
        same = fits & (known[size][np.minimum(at, n - 1)] == known[size][np.minimum(bt, n - 1)])
        common[same] += size
    for _ in range(7):
        at, bt = a + common, b + common
        fits = (common < depth) & (at < n) & (bt < n)
        common[fits & (data[np.minimum(at, n - 1)] == data[np.minimum(bt, n - 1)])] += 1
    left = np.where(order > 0, data[np.maximum(order - 1, 0)].astype(np.int32), -1)
    return order, common, left


def removed_spans(stretch: list[tuple[int, int, int, bytes]], length: int, cut: int | None = None) -> list[tuple]:
    """(key, start, stop, window, doc) of the bytes to remove in stretches (doc, key, start, bytes) of whole groups.

    The stretches from number ``cut`` on are of a group that goes on: their other windows are given out too, by their hashes and without a stop.
    """
    sizes = np.array([len(x[3]) for x in stretch])
    data = np.frombuffer(b"".join(x[3] for x in stretch), np.uint8)
    first = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(stretch), dtype=np.int32), sizes)
    docs = np.array([x[0] for x in stretch])
    order, common, _ = suffix_array(data, length)
    order_of = of[order]
    whole = order + length <= (first + sizes)[order_of]
    # a suffix too near the end of its stretch is no occurrence; its node is the one of the others
    node = np.cumsum(np.concatenate(([0], common < length)))
    doc = np.where(whole, docs[order_of], LAST)
    start = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    least = np.minimum.reduceat(doc, start)[node]
    gone = order[whole & (least < doc)]
    onward = []
    if cut is not None:
        open_ = np.sort(order[whole & (least >= doc) & (order_of >= cut)]).astype(np.int64)
        window, i = span_hashes(data, open_, open_ + length).view(np.int64), of[open_]
        key, begin = np.array([x[1] for x in stretch])[i], np.array([x[2] for x in stretch])[i] + open_ - first[i]
        onward = [(k, a, None, w, d) for k, a, w, d in zip(key.tolist(), begin.tolist(), window.tolist(), docs[i].tolist())]
    if not len(gone):
        return onward
    gone.sort()
    at = of[gone]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (gone[1:] > gone[:-1] + length))))
    ends = np.append(new[1:], len(gone)) - 1
    return [(stretch[at[i]][1], int(stretch[at[i]][2] + gone[i] - first[at[i]]), int(stretch[at[i]][2] + gone[j] - first[at[i]] + length), None, None)
            for i, j in zip(new, ends)] + onward


def repeat_groups(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, list[tuple[int, int]]]]:
    """Maximal repeats of one group: (bytes, all occurrences as (text, start)), repeats of at least ``length`` bytes.

    A stack over the common prefixes keeps the open intervals of the tree; one
    that closes is given out if the bytes before its occurrences differ.
    """
    if not texts:
        return []
    # an end mark of its own after each text keeps common prefixes within texts
    data = np.concatenate([np.append(np.frombuffer(t, np.uint8).astype(np.int64) + len(texts), i) for i, t in enumerate(texts)])
    sizes = np.array([len(t) + 1 for t in texts])
    order, common, left = suffix_array(data, max(8, int(sizes.max())))
    first = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(texts)), sizes)[order]
    bound = np.append(common, 0)
    out, stack = [], []  # of (bytes, first suffix)
    for i, depth in enumerate(bound.tolist()):
        low = i
        while stack and stack[-1][0] > depth:
            size, low = stack.pop()
            if size >= length and len(set(left[low : i + 1].tolist())) > 1:
                out.append((size, sorted((int(of[j]), int(order[j] - first[of[j]])) for j in range(low, i + 1))))
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, low))
    return out


def spans(groups: DataFrame, length: int) -> DataFrame:
    """(key, start, stop, grp, doc) to remove, reading groups about BLOCK bytes at a time; without a stop, windows of a group that was too large.

    What is held is at most LARGEST bytes of a group, and of windows with one hash the smallest doc.
    """
    names = ["key", "start", "stop", "grp", "doc"]
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size, group, begin, split = 0, None, 0, False
        window, least = None, 0

        def answer(found):
            return pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*found)) or [()] * 5, types)], names=names)

        for batch in batches:
            bare = np.asarray(batch.column("part").is_null())
            single = bare & np.asarray(batch.column("stop").is_null())
            known = batch.filter(pa.array(bare & ~single))
            if len(known):
                yield pa.record_batch([*known.select(names[:3]).columns, pa.nulls(len(known), pa.int64()), pa.nulls(len(known), pa.int64())], names=names)
            if single.any():  # sorted by hash and doc
                of, doc, key, start = (batch.column(c).to_numpy()[single] for c in ("grp", "doc", "key", "start"))
                new = np.concatenate(([True], of[1:] != of[:-1]))
                low = doc[np.flatnonzero(new)]
                if window == of[0]:
                    low[0] = least
                low = low[np.cumsum(new) - 1]
                window, least = of[-1], low[-1]
                later = doc > low
                if later.any():
                    key, start, stop = merged_windows(key[later], start[later], length)
                    yield pa.record_batch([pa.array(key), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)),
                                           pa.nulls(len(key), pa.int64()), pa.nulls(len(key), pa.int64())], names=names)
            rows = batch.filter(pa.array(~bare))
            for grp, doc, key, start, part in zip(*[rows.column(c).to_pylist() for c in ("grp", "doc", "key", "start", "part")]):
                if grp != group:
                    if split or size > BLOCK:
                        yield answer(removed_spans(held, length, begin if split else None))
                        held, size = [], 0
                    group, begin, split = grp, len(held), False
                for at in range(0, max(1, len(part) - length + 1), LARGEST):
                    piece = part[at : at + LARGEST + length - 1]
                    if held and size + len(piece) > LARGEST:
                        if len(held) > begin:
                            split = True
                        yield answer(removed_spans(held, length, begin if split else None))
                        held, size, begin = [], 0, 0
                    held.append((doc, key, start + at, piece))
                    size += len(piece)
        if held:
            yield answer(removed_spans(held, length, begin if split else None))

    schema = "key bigint, start int, stop int, grp bigint, doc bigint"
    return groups.repartition("grp").sortWithinPartitions("grp", "doc").mapInArrow(run, schema)


def joined_spans(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlap; touching ones are one."""
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_bytes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row: ``id``, ``bytes`` of the text and the ``spans`` (start, stop) to remove."""
    texts = docs.select(docs[id_column].cast("bigint").alias("id"), text_of(docs, text_column).alias("text")).withColumn("key", F.xxhash64("text"))
    order = F.coalesce("id", F.lit(LAST))
    classes = written(texts.groupBy("key").agg(F.min(order).alias("doc"), F.max(order).alias("last")))
    shared = shared_signatures(anchor_rows(texts.filter(F.octet_length("text") >= length), length), HOT)
    held = shared.groupBy(F.col("node").alias("key")).agg(*[F.collect_list(c).alias(c) for c in ("sig", "leader", "hot")])
    rows = packed_texts(texts.filter(F.octet_length("text") >= length)).join(held.join(classes.select("key", "doc"), "key"), "key")
    found = spans(stretches(rows.select("key", "doc", "packed", "sig", "leader", "hot"), length), length)
    found = written(found)
    rest = found.filter("stop is null").select("grp", "doc", "key", "start", "stop", F.lit(None).cast("binary").alias("part"))
    found = found.filter("stop is not null").unionByName(spans(rest, length)).select("key", "start", "stop")
    found = found.groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("found"))
    marks = written(classes.join(found, "key", "left").filter("found is not null or doc < last"))
    marked = texts.join(small(marks), "key", "left")
    size = F.octet_length("text")
    whole = F.array(F.struct(F.lit(0).alias("start"), size.alias("stop")))
    copy = (F.col("doc") < order) & (size >= length)
    return marked.select("id", "text", size.alias("bytes"), F.when(copy, whole).otherwise(F.col("found")).alias("found"))


def kept_texts(marked: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and their SHA-256."""
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, found in zip(batch.column("id").to_pylist(), batch.column("text"), batch.column("found").to_pylist()):
                data = memoryview(text.as_buffer())
                cut = joined_spans([(x["start"], x["stop"]) for x in found or ()])
                digest, at = hashlib.sha256(), 0
                for a, b in cut:
                    digest.update(data[at:a])
                    at = b
                digest.update(data[at:])
                out.append((doc, len(data), sum(b - a for a, b in cut), len(cut), digest.hexdigest()))
            columns = list(zip(*out)) or [()] * 5
            yield pa.record_batch([pa.array(c, pa.string() if i == 4 else pa.int64()) for i, c in enumerate(columns)],
                                  names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return marked.select("id", "text", "found").mapInArrow(run, schema)
