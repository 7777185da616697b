"""N-gram Jaccard join by parity sketches.

The tokens (shingles) of a set are hashed to one position each of a bit sketch
and flip the bit there, so the Hamming distance of two sketches is at most the
size of the symmetric difference of the sets.  A pair of at least the wanted
similarity differs in at most D tokens, D following from the sizes.  Sets are
put into bands by size; per band the (virtual, 2**64 bits wide) sketch is cut
into D + 1 + slack blocks, of which at least 1 + slack agree for every such
pair.  The join is on the content of the blocks:

1. Sets that are equal become one node, so copies are never paired.
2. Blocks held by one node only are dropped; of the others, each node meets the
   first node of the block (a star, linear in the rows).
3. Nodes joined through those stars are one component; only nodes of different
   components that still share a block are paired.  A block held by more than
   ``HOT`` nodes is left out for a node whose empty and hot blocks are no more
   than the slack: a similar node then shares another block with it.  What
   still shares hot blocks is compared packet by packet on folded sketches, and
   only pairs within the Hamming bound leave the task.
4. Every pair is checked on the folded sketches, then on the shingles.

The links of these steps span every component; a pair of sets that others have
joined already is not among them.  ``all_links`` gives every link: both ends of a
link are in one component, so the sets of each component are compared with each
other, packet by packet, on their shingles.  ``n_links`` is summed in the tasks,
so counting links makes no row per pair.

Rows: null or empty texts and texts without words have no shingles and link
with nothing.  Rows repeated with the same id are separate rows of the same
node.  A null id keeps its row and never becomes a component id while the
component holds another.  Columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.llm.common import small, spread_join, text_of, written
from corpusloom.llm.textkernel import WIDTH, mix, mixed, shingle_sets

HOT = 32
PACKET = 256
MEMBERS = 512
PACKET_SHINGLES = 1 << 19
COLUMNS = 4096
COUNTED = 1 << 18
EDGES = [4]
while EDGES[-1] < 1 << 40:
    EDGES.append(max(EDGES[-1] + 1, -(-EDGES[-1] * 3 // 2)))
BANDS = 64


def apart(total: int, percent: int) -> int:
    """Most tokens in which two sets of this total size and at least this similarity differ."""
    return total * (100 - percent) // (100 + percent)


class Bands:
    """Sizes, blocks and sketch bits of every band."""

    def __init__(self, percent: int):
        self.percent = percent
        self.far = [apart(2 * (edge - 1), percent) for edge in EDGES[1:]]
        self.slack = [-(-d * 12 // 100) + 1 for d in self.far]
        self.blocks = [d + 1 + s for d, s in zip(self.far, self.slack)]
        self.words = [max(1, -(-8 * d // 64)) for d in self.far]
        self.least = min((n for n in range(1, 101) if apart(2 * n + 1, percent) >= 1), default=101)

    def of(self, n: int) -> list[int]:
        """The band of a size, and the next one if a similar set can be that large."""
        if n < max(EDGES[0], self.least):
            return []
        b = int(np.searchsorted(EDGES, n, "right")) - 1
        return [b, b + 1] if n * 100 // self.percent >= EDGES[b + 1] else [b]

    def sketch(self, tokens: np.ndarray, band: int) -> np.ndarray:
        """The folded parity sketch, 64 bits to a value."""
        bits = self.words[band] * 64
        odd = np.bincount((mix(tokens) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64)

    def signatures(self, tokens: np.ndarray, band: int) -> tuple[np.ndarray, int]:
        """Block contents (the band in the lowest six bits) and the number of empty blocks.

        Empty blocks are given out only where there are more than the slack.
        """
        m = self.blocks[band]
        block = ((tokens >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        ids, content = block[first], np.bitwise_xor.reduceat(tokens, first)
        empty = m - len(ids)
        if empty > self.slack[band]:
            missing = np.setdiff1d(np.arange(m, dtype=np.uint64), ids)
            ids, content = np.concatenate((ids, missing)), np.concatenate((content, np.zeros(len(missing), np.uint64)))
        out = mix(content ^ mix(ids + np.uint64(mixed(band, self.percent))))
        return ((out & ~np.uint64(BANDS - 1)) | np.uint64(band)).view(np.int64), empty


def fingerprint(tokens: np.ndarray) -> int:
    """One number for a set of hashes."""
    total = np.add.reduce(mix(tokens ^ np.uint64(mixed(7)))) if len(tokens) else np.uint64(0)
    return int(mix(np.array([total + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def profiles(docs: DataFrame, bands: Bands, width: int) -> DataFrame:
    """Per row: id, text key, node, size, folded sketches, empty blocks of both bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("node", "n", "own", "next", "empty", "empty_next")}
            for tokens in shingle_sets(batch.column("text"), width):
                of = bands.of(len(tokens))
                out["node"].append(fingerprint(tokens))
                out["n"].append(len(tokens))
                for name, free, k in (("own", "empty", 0), ("next", "empty_next", 1)):
                    out[name].append(bands.sketch(tokens, of[k]) if len(of) > k else None)
                    out[free].append(bands.signatures(tokens, of[k])[1] if len(of) > k else None)
            yield pa.record_batch(
                [batch.column("id"), batch.column("key"), pa.array(out["node"], pa.int64()), pa.array(out["n"], pa.int64()),
                 *[pa.array(out[k], pa.list_(pa.int64())) for k in ("own", "next")],
                 *[pa.array(out[k], pa.int32()) for k in ("empty", "empty_next")]],
                names=["id", "key", "node", "n", "own", "next", "empty", "empty_next"],
            )

    schema = "id bigint, key bigint, node bigint, n bigint, own array<bigint>, next array<bigint>, empty int, empty_next int"
    return docs.mapInArrow(run, schema)


def signature_rows(docs: DataFrame, bands: Bands, width: int) -> DataFrame:
    """(signature, node), once per node and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sigs, nodes, held = [], [], 0
            for tokens in shingle_sets(batch.column("text"), width):
                of = bands.of(len(tokens))
                if not of or (node := fingerprint(tokens)) in seen:
                    continue
                seen.add(node)
                for b in of:
                    sigs.append(bands.signatures(tokens, b)[0])
                    nodes.append(np.full(len(sigs[-1]), node, np.int64))
                    held += len(sigs[-1])
                if held > 500_000:
                    yield pa.record_batch([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(nodes))], names=["sig", "node"])
                    sigs, nodes, held = [], [], 0
            if sigs:
                yield pa.record_batch([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(nodes))], names=["sig", "node"])

    return docs.select("text").mapInArrow(run, "sig bigint, node bigint")


def shared_signatures(rows: DataFrame, most: int = HOT) -> DataFrame:
    """Rows of signatures that several nodes have: the first node as leader, and whether more than ``most`` have it.

    Reads sorted rows as a stream; what is held of a signature is at most ``most`` rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_sig, held = None, np.zeros(0, np.int64)
        leader, last = 0, 0  # of a signature already known to be hot
        hot = False

        def rows_of(sig, node, lead, is_hot):
            return pa.record_batch([pa.array(sig), pa.array(node), pa.array(lead), pa.array(is_hot)], names=["sig", "node", "leader", "hot"])

        for batch in batches:
            sig = batch.column("sig").to_numpy()
            node = batch.column("node").to_numpy()
            if not len(sig):
                continue
            if held_sig is not None and hot and sig[0] == held_sig:  # more rows of the hot one
                k = int(np.searchsorted(sig, held_sig, "right"))
                more = node[:k][np.concatenate(([node[0] != last], node[1:k] != node[: k - 1]))]
                if len(more):
                    last = more[-1]
                    yield rows_of(np.full(len(more), held_sig), more, np.full(len(more), leader), np.ones(len(more), bool))
                sig, node = sig[k:], node[k:]
                if not len(sig):
                    continue
            if held_sig is not None and not hot:
                sig, node = np.concatenate((np.full(len(held), held_sig), sig)), np.concatenate((held, node))
            new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])))
            sig, node = sig[new], node[new]
            first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            size = np.diff(np.append(first, len(sig)))
            keep = size > 1
            held_sig, held, hot = sig[-1], node[first[-1] :], False
            if size[-1] <= most:
                keep[-1] = False  # may go on in the next batch
            else:
                hot, leader, last = True, node[first[-1]], node[-1]
            many, lead = np.repeat(size > most, size), np.repeat(node[first], size)
            use = np.repeat(keep, size)
            if use.any():
                yield rows_of(sig[use], node[use], lead[use], many[use])
        if held_sig is not None and not hot and len(held) > 1:
            yield rows_of(np.full(len(held), held_sig), held, np.full(len(held), held[0]), np.zeros(len(held), bool))

    return rows.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(run, "sig bigint, node bigint, leader bigint, hot boolean")


def needed(shared: DataFrame, nodes: DataFrame, bands: Bands) -> DataFrame:
    """Shared signatures without hot ones of nodes that a similar node meets elsewhere."""
    slack = F.array(*[F.lit(s) for s in bands.slack[:BANDS]])
    edges = F.array(*[F.lit(e) for e in EDGES[: BANDS]])
    band = F.shiftrightunsigned(F.shiftleft("sig", 58), 58).cast("int")
    counted = shared.filter("hot").groupBy("node", band.alias("band")).count().join(nodes.select("node", "n", "empty", "empty_next"), "node")
    free = F.when(F.col("n") >= F.element_at(edges, F.col("band") + 1), F.col("empty")).otherwise(F.col("empty_next"))
    room = F.element_at(slack, F.col("band") + 1)
    must = counted.filter(F.when(free > room, 0).otherwise(free) + F.col("count") > room).select("node", "band")
    kept = shared.filter("hot").withColumn("band", band).join(must, ["node", "band"], "left_semi").select(shared.columns)
    return shared.filter(~F.col("hot")).unionByName(kept)


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) within the size bound whose sketches lie within the Hamming bound."""
    sides = [nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "own", "next")]) for x in "ab"]
    low, high = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    far = F.floor((F.col("n_a") + F.col("n_b")) * (100 - percent) / (100 + percent))
    joined = pairs.join(sides[0], "a").join(sides[1], "b").filter(low * 100 >= high * percent)
    same = F.size("own_a") == F.size("own_b")
    a = F.when(same | (F.col("n_a") > F.col("n_b")), F.col("own_a")).otherwise(F.col("next_a"))
    b = F.when(same | (F.col("n_b") > F.col("n_a")), F.col("own_b")).otherwise(F.col("next_b"))
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return joined.filter(differ <= far).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose shingle sets have the wanted similarity.

    The texts of one row per node are read again; the members of ``a`` meet its
    set in packets, so that a node with very many partners is split.
    """
    packets = F.ceil(F.count("*").over(Window.partitionBy("a")) / MEMBERS).cast("int")
    dealt = written(pairs.withColumn("packet", F.pmod(F.xxhash64("b"), packets).cast("int")))
    asked = dealt.select("a", "packet", F.col("b").alias("node")).unionByName(dealt.select("a", "packet", F.col("a").alias("node")).distinct())
    asked = written(asked.join(nodes.select("node", "id", "key"), "node"))
    texts = docs.withColumnRenamed("id", "doc").join(
        small(asked.withColumnRenamed("key", "wanted")), (F.col("key") == F.col("wanted")) & F.col("doc").eqNullSafe(F.col("id")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, node = batch.column("a").to_numpy(), batch.column("node").to_numpy()
            held = [x.tobytes() for x in shingle_sets(batch.column("text"), width)]
            yield pa.record_batch(
                [batch.column("a"), batch.column("packet"), pa.array(lead != node), batch.column("node"), pa.array(held, pa.binary())],
                names=["a", "packet", "member", "b", "tokens"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, lead = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b, found = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            packet, tokens = batch.column("packet").to_pylist(), batch.column("tokens")
            for i in range(len(a)):
                mine = np.frombuffer(tokens[i].as_buffer(), np.uint64)
                if a[i] == b[i]:
                    of, lead = (a[i], packet[i]), mine
                elif of == (a[i], packet[i]) and len(lead):
                    at = np.minimum(np.searchsorted(lead, mine), len(lead) - 1)
                    both = int(np.count_nonzero(lead[at] == mine))
                    if both * (100 + percent) >= percent * (len(mine) + len(lead)):
                        found.append(i)
            if found:
                yield batch.select(["a", "b"]).take(pa.array(found))

    return (
        texts.select("a", "packet", "node", "text").mapInArrow(sets, "a bigint, packet int, member boolean, b bigint, tokens binary")
        .repartition("a", "packet").sortWithinPartitions("a", "packet", "member", "b")
        .mapInArrow(check, "a bigint, b bigint").distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node with a link; labels halve their way each round."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")))
    while True:
        seen = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("root").alias("seen"))
        lower = label.join(seen, label["node"] == seen["a"]).select("node", F.col("root").alias("was"), F.least("root", "seen").alias("root"))
        up = label.select(F.col("node").alias("root"), F.col("root").alias("above"))
        moved = written(lower.join(up, "root", "left").select("node", "was", F.least("root", "above").alias("root")))
        label = moved.select("node", "root")
        if moved.filter("root <> was").isEmpty():
            return label


def with_component(rows: DataFrame, label: DataFrame) -> DataFrame:
    return rows.join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))


def cross_pairs(shared: DataFrame, label: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a needed signature."""
    rows = written(with_component(shared, label))
    open_ = rows.groupBy("sig").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("sig")
    rows = written(rows.join(open_, "sig", "left_semi"))
    cold = rows.filter(~F.col("hot")).select("sig", "node", "root")
    other = cold.select("sig", F.col("node").alias("b"), F.col("root").alias("root_b"))
    pairs = cold.join(other, "sig").filter((F.col("node") < F.col("b")) & (F.col("root") != F.col("root_b")))
    pairs = plausible(pairs.select(F.col("node").alias("a"), "b").distinct(), nodes, percent)
    return pairs.unionByName(hot_pairs(rows.filter("hot"), nodes, percent))


class Packet:
    """Nodes, roots and sizes of some sets, and by width the sketches with the row that each belongs to."""

    def __init__(self, rows: pa.StructArray):
        node, root, n, *sketches = rows.flatten()
        self.node, self.root, self.n = node.to_numpy(), root.to_numpy(), n.to_numpy()
        held: dict[int, list] = {}
        for column in sketches:
            width = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
            flat, start = column.flatten().to_numpy(), np.cumsum(width) - width
            for w in np.unique(width[width > 0]).tolist():
                at = np.flatnonzero(width == w)
                held.setdefault(w, []).append((at, flat[start[at][:, None] + np.arange(w)]))
        self.sketches = {w: tuple(np.concatenate(x) for x in zip(*parts)) for w, parts in held.items()}


def near_pairs(left: Packet, right: Packet, percent: int, step: int = 64) -> np.ndarray:
    """Pairs of nodes of different roots within the size and Hamming bounds."""
    out = [np.zeros((0, 2), np.int64)]
    for w in left.sketches.keys() & right.sketches.keys():
        rows, table = left.sketches[w]
        at, other = right.sketches[w]
        for k in range(0, len(rows), step):
            i = rows[k : k + step]
            n, m = left.n[i][:, None], right.n[at][None, :]
            ok = (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent) & (left.root[i][:, None] != right.root[at][None, :])
            some = np.flatnonzero(ok.any(axis=0))
            if not len(some):
                continue
            differ = np.bitwise_count((table[k : k + step, None, :] ^ other[None, some, :]).view(np.uint64)).sum(axis=2, dtype=np.int64)
            x, y = np.nonzero(ok[:, some] & (differ <= (n + m[:, some]) * (100 - percent) // (100 + percent)))
            out.append(np.stack((left.node[i[x]], right.node[at[some[y]]]), axis=1))
    return np.unique(np.concatenate(out), axis=0)


def hot_pairs(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs within the Hamming bound among nodes that share hot signatures, compared packet by packet.

    Signatures go together by the component that most of their nodes have, so a
    pair is met about once however many signatures it shares.  Packets of nodes
    outside that component meet every packet of the group.
    """
    main = rows.groupBy("sig", "root").count().groupBy("sig").agg(F.max_by("root", F.struct("count", "root")).alias("grp"))
    group = rows.join(main, "sig").select("grp", "node", "root").distinct()
    group = written(group.join(nodes.select("node", "n", "own", "next"), "node"))
    sizes = group.groupBy("grp").agg(F.ceil(F.count("*") / PACKET).alias("packets"))
    dealt = group.join(sizes, "grp").withColumn("packet", F.pmod(F.xxhash64("node"), "packets"))
    packed = F.collect_list(F.struct("node", "root", "n", "own", "next"))
    inside = dealt.groupBy("grp", "packet").agg(packed.alias("right"))
    outside = dealt.filter("root <> grp").groupBy("grp", F.col("packet").alias("of")).agg(packed.alias("left"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column("left"), batch.column("right")):
                found = near_pairs(Packet(left.values), Packet(right.values), percent)
                if len(found):
                    yield pa.record_batch([pa.array(found.min(axis=1)), pa.array(found.max(axis=1))], names=["a", "b"])

    met = outside.join(inside, "grp").select("left", "right")
    return met.mapInArrow(run, "a bigint, b bigint").distinct()


def links(docs: DataFrame, percent: int = 80, width: int = WIDTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles of all rows, nodes, and links between nodes: spanning every component (stars first, then what they left apart)."""
    bands = Bands(percent)
    rows = docs.select(F.col("id").cast("bigint"), F.col("text"), F.xxhash64("text").alias("key"))
    seen = written(profiles(rows, bands, width))
    first = F.struct(F.col("id").isNull(), "id", "key")
    nodes = written(seen.filter("n > 0").groupBy("node").agg(
        F.min(first).alias("first"), F.min("id").alias("least_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("own").alias("own"),
        F.first("next").alias("next"), F.first("empty").alias("empty"), F.first("empty_next").alias("empty_next"),
    ).select("node", F.col("first.id").alias("id"), F.col("first.key").alias("key"), "copies", "n", "own", "next", "empty", "empty_next"))
    shared = written(shared_signatures(signature_rows(rows, bands, width)))
    shared = written(needed(shared, nodes, bands))
    star = shared.filter("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    found = written(verified(plausible(star, nodes, percent), rows, nodes, width, percent))
    label = components(found)
    more = written(verified(cross_pairs(shared, label, nodes, percent), rows, nodes, width, percent))
    return seen, nodes, found.unionByName(more)


def similar_sets(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether each left set has the wanted similarity to each right one, from the exact numbers of common shingles."""
    sides = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(s) for s in x])) for x in (left, right)]
    common = np.intersect1d(sides[0][0], sides[1][0])
    both = np.zeros((len(left), len(right)), np.int64)
    if len(common):
        cells = []
        for tokens, owner in sides:
            at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
            use = common[at] == tokens
            order = np.argsort(at[use], kind="stable")
            cells.append((at[use][order], owner[use][order]))
        for k in range(0, len(common), COLUMNS):
            parts = []
            for (at, owner), n in zip(cells, both.shape):
                i, j = np.searchsorted(at, (k, k + COLUMNS))
                parts.append(np.zeros((n, min(COLUMNS, len(common) - k)), np.float32))
                parts[-1][owner[i:j], at[i:j] - k] = 1
            both += (parts[0] @ parts[1].T).astype(np.int64)
    total = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :]
    return both * (100 + percent) >= percent * total


def linked_packets(docs: DataFrame, nodes: DataFrame, label: DataFrame, width: int) -> DataFrame:
    """(left, right): every two packets of every component, as lists of (node, copies, tokens); right is null for a packet with itself."""
    placed = written(label.join(nodes.select("node", "id", "key", "n", "copies"), "node"))
    sizes = placed.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / PACKET), F.ceil(F.sum("n") / PACKET_SHINGLES)).cast("int").alias("packets"))
    dealt = placed.join(sizes, "root").withColumn("packet", F.pmod(F.xxhash64("node"), "packets").cast("int"))
    dealt = written(dealt.select("node", "root", "packets", "packet", "copies", F.col("id").alias("node_id"), F.col("key").alias("node_key")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            use = []
            for i, node in enumerate(batch.column("node").to_pylist()):
                if node not in seen:
                    seen.add(node)
                    use.append(i)
            some = batch.take(pa.array(use, pa.int64()))
            held = [x.tobytes() for x in shingle_sets(some.column("text"), width)]
            yield pa.record_batch([*some.select(["root", "packets", "packet", "node", "copies"]).columns, pa.array(held, pa.binary())],
                                  names=["root", "packets", "packet", "node", "copies", "tokens"])

    def packed(which: DataFrame) -> DataFrame:
        texts = docs.join(small(written(which)), (F.col("key") == F.col("node_key")) & F.col("id").eqNullSafe(F.col("node_id")))
        out = texts.select("root", "packets", "packet", "node", "copies", "text").mapInArrow(
            sets, "root bigint, packets int, packet int, node bigint, copies bigint, tokens binary")
        return out.groupBy("root", "packets", "packet").agg(F.collect_list(F.struct("node", "copies", "tokens")).alias("held"))

    kind = "array<struct<node:bigint,copies:bigint,tokens:binary>>"
    alone = packed(dealt.filter("packets = 1")).select(F.col("held").alias("left"), F.lit(None).cast(kind).alias("right"))
    several = written(packed(dealt.filter("packets > 1")))
    itself = several.select(F.col("held").alias("left"), F.lit(None).cast(kind).alias("right"))
    # keyed by both numbers, so that the packets of one large component are spread over tasks
    left = several.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("packets") - 1))).filter("other > packet")
    left = left.select("root", "packet", "other", F.col("held").alias("left"))
    right = several.withColumn("before", F.explode(F.sequence(F.lit(0), F.col("packets") - 1))).filter("before < packet")
    right = right.select("root", F.col("before").alias("packet"), F.col("packet").alias("other"), F.col("held").alias("right"))
    return alone.unionByName(itself).unionByName(left.join(right, ["root", "packet", "other"]).select("left", "right"))


def met_sets(packets: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Nodes, copies and shingle sets of a packet, each node once."""
    node, copies, tokens = packets.values.flatten()
    node, first = np.unique(node.to_numpy(), return_index=True)
    return node, copies.to_numpy()[first], [np.frombuffer(tokens[int(i)].as_buffer(), np.uint64) for i in first]


def met_packets(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[tuple]:
    """Nodes and copies of either side, and which of them are linked, for each two packets."""
    for batch in batches:
        for left, right in zip(batch.column("left"), batch.column("right")):
            a, copies_a, mine = met_sets(left)
            b, copies_b, others = met_sets(right) if right.is_valid else (a, copies_a, mine)
            near = similar_sets(mine, others, percent)
            if not right.is_valid:
                near = np.triu(near, 1)
            yield a, copies_a, b, copies_b, near


def all_links(docs: DataFrame, nodes: DataFrame, label: DataFrame, percent: int = 80, width: int = WIDTH) -> DataFrame:
    """(a, b), a < b: every two different sets of the wanted similarity, by their nodes; ``docs`` has id, text and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, _, b, _, near in met_packets(batches, percent):
            x, y = np.nonzero(near)
            yield pa.record_batch([pa.array(np.minimum(a[x], b[y])), pa.array(np.maximum(a[x], b[y]))], names=["a", "b"])

    return linked_packets(docs, nodes, label, width).mapInArrow(run, "a bigint, b bigint")


def link_counts(docs: DataFrame, nodes: DataFrame, label: DataFrame, percent: int = 80, width: int = WIDTH) -> DataFrame:
    """(node, met): how many rows of other nodes each node is linked with, summed in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, met, held = [], [], 0

        def summed():
            names, at = np.unique(np.concatenate(node), return_inverse=True)
            out = np.zeros(len(names), np.int64)
            np.add.at(out, at, np.concatenate(met))
            return names, out

        for a, copies_a, b, copies_b, near in met_packets(batches, percent):
            node += [a, b]
            met += [near @ copies_b, copies_a @ near]
            held += len(a) + len(b)
            if held > COUNTED:
                names, out = summed()
                if len(names) > COUNTED // 2:
                    yield pa.record_batch([pa.array(names), pa.array(out)], names=["node", "met"])
                    node, met, held = [], [], 0
                else:
                    node, met, held = [names], [out], len(names)
        if node:
            names, out = summed()
            yield pa.record_batch([pa.array(names), pa.array(out)], names=["node", "met"])

    counts = linked_packets(docs, nodes, label, width).mapInArrow(run, "node bigint, met bigint")
    return counts.groupBy("node").agg(F.sum("met").alias("met"))


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = 80, width: int = WIDTH,
                       count_links: bool = False, with_group: bool = False) -> DataFrame:
    """One row per document: ``id``, ``key`` (text hash), ``n`` shingles and ``component``, the smallest id reachable over links.

    With ``with_group`` also ``grp``, one value per group of linked rows, which tells groups without any id apart; null without words.

    With ``count_links`` also ``n_links``, the number of other rows with the wanted similarity, equal ones among them.
    """
    rows = docs.select(docs[id_column].alias("id"), text_of(docs, text_column).alias("text"))
    seen, nodes, linked = links(rows, percent, width)
    if count_links:
        linked = written(linked)
    label = components(linked)
    placed = with_component(nodes.select("node", "id"), label)
    least = placed.groupBy("root").agg(F.min("id").alias("component"))
    table = placed.join(least, "root").select("node", "component", *([F.col("root").alias("grp")] if with_group else []))
    if count_links:
        keyed = rows.select(F.col("id").cast("bigint"), "text", F.xxhash64("text").alias("key"))
        met = written(link_counts(keyed, nodes, label, percent, width))
        own = nodes.select("node", "copies").join(met, "node", "left")
        table = table.join(own.select("node", (F.col("copies") - 1 + F.coalesce("met", F.lit(0))).alias("n_links")), "node")
    out = spread_join(seen.select("id", "key", "node", "n"), table, "node", F.xxhash64("id"))
    more = [F.coalesce("n_links", F.lit(0)).alias("n_links")] if count_links else []
    return out.select("id", "key", "n", F.coalesce("component", "id").alias("component"), *more, *(["grp"] if with_group else []))
