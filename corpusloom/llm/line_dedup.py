"""Line dedup by an exact set-similarity join.

A line is its set of words.  Tokens are ordered by rarity (words counted over
all lines; those below one in a million count as equally rare and go by hash,
which is still one order for all).  Two sets of similarity t or more share a
token within the first |x| - ceil(t |x|) + 1 of each (prefix filter).

1. Equal sets are one set; its place is its first occurrence.
2. A word that occurs once in the corpus is shared by no two lines; a filter of all
   other words keeps such tokens out.  Rows of prefix tokens are sorted by token and size and read as a stream.  Sets
   that share a token are candidates if they pass the length filter and a filter
   on the words in which they differ.  Two sets meet at the first token they share:
   the words before it differ, and those from it on differ at least in as many
   words as their numbers or their parity bits do.  Sets of many words have more
   than 64 such bits, since two large sets may differ in more words than that.
3. A token with many candidates per set (a group of near copies), or with more
   sets than a task holds, gives out its rows instead.  There each set meets the
   first one; the later of two similar sets is settled: its lines go.  Sets not
   settled then meet the other sets of such tokens under the same filters, so
   members of a group of near copies are not paired with each other.
4. Candidates are verified on the words, each set with its earliest candidate first.

A line goes if an earlier line, by (id, line number), has a similarity of t or
more, judged on the input: also a line that goes makes later ones go.  Lines of
fewer than ``MIN_WORDS`` different words always stay.

Rows: null or empty texts have no lines and stay as they are.  Repeated rows
with one id count as one document.  Null ids come before all others.  Other
columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.common import deleted, fresh, small, text_of, written
from corpusloom.llm.textkernel import LOWER, SPACE, mix, mixed, pieces, span_hashes, word_bounds, word_hashes

PERCENT = 80
MIN_WORDS = 3
RARE = 1_000_000
FILTER_BITS = 1 << 28
MOST_WIDE = 16
BREAK = 10
HELD = 10_000
DENSE = 8


class Lines:
    """The word sets of the lines of one piece of a text column, as one sorted array.

    ``where`` has (row, line number) per line, ``word`` the distinct words of the
    piece from rare to frequent, ``rank`` the words of all lines as places in it,
    each line's from the rarest, ``first`` the start of each line in ``rank``,
    ``bits`` the parity bits of a line's words from each place in ``rank`` on.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, common: tuple[np.ndarray, np.ndarray] | None = None):
        low = LOWER[data]
        starts, ends, _ = word_bounds(SPACE[low], offsets)
        breaks = np.flatnonzero(data == BREAK)
        row = np.searchsorted(offsets, starts, "right") - 1
        number = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[:-1])[row]
        new = np.concatenate(([True], (row[1:] != row[:-1]) | (number[1:] != number[:-1])))[: len(starts)]
        self.where = np.stack((row[new], number[new]))
        self.word, at = np.unique(span_hashes(low, starts, ends), return_inverse=True)
        if common is not None:
            order = np.argsort(rarity(self.word, common))
            self.word, place = self.word[order], np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            at = place[at]
        cell = np.sort(((np.cumsum(new) - 1) << 32) | at)
        cell = cell[np.concatenate(([True], cell[1:] != cell[:-1]))[: len(cell)]]
        self.rank, line = cell & 0xFFFFFFFF, cell >> 32
        self.first = np.searchsorted(line, np.arange(self.where.shape[1] + 1))
        self.size = np.diff(self.first)
        self.odd = odd = mix(self.word ^ np.uint64(mixed(7)))
        parts = odd[self.rank]
        before = np.zeros(len(self.rank) + 1, np.uint64)
        np.bitwise_xor.accumulate((np.uint64(1) << (odd & np.uint64(63)))[self.rank], out=before[1:])
        self.bits = (before[np.repeat(self.first[1:], self.size)] ^ before[:-1]).view(np.int64)
        sums = np.add.reduceat(parts, self.first[:-1]) if len(parts) else np.zeros(0, np.uint64)
        self.node = mix(sums + self.size.astype(np.uint64)).view(np.int64)

    def more_bits(self, line: np.ndarray, at: np.ndarray, wide: np.ndarray) -> pa.ListArray:
        """Parity bits of the words of ``line`` from its place ``at`` on, in ``wide`` numbers; null where that is 1."""
        count = np.where(wide > 1, wide, 0)
        first = np.concatenate(([0], np.cumsum(count)))
        out = np.zeros(first[-1], np.uint64)
        for w in np.unique(count[count > 0]):
            rows = np.flatnonzero(count == w)
            lines, own = np.unique(line[rows], return_inverse=True)
            begin = np.concatenate(([0], np.cumsum(self.size[lines])))
            place = np.arange(begin[-1]) + np.repeat(self.first[lines] - begin[:-1], self.size[lines])
            odd = self.odd[self.rank[place]]
            before = np.zeros((len(odd) + 1, w), np.uint64)
            before[np.arange(1, len(odd) + 1), ((odd >> np.uint64(6)) & np.uint64(w - 1)).astype(np.int64)] = np.uint64(1) << (odd & np.uint64(63))
            before = np.bitwise_xor.accumulate(before, axis=0)
            out[first[rows][:, None] + np.arange(w)] = before[begin[own + 1]] ^ before[begin[own] + at[rows]]
        return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(out.view(np.int64)), mask=pa.array(count == 0))


def width(size: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """How many numbers of 64 parity bits a row has: a power of two, so that there are three bits for each word in which two such sets may differ from there on."""
    differ = 2 * size * (100 - percent) // (100 + percent) - at
    return np.minimum(1 << np.ceil(np.log2(np.maximum(differ * 3, 64) / 64)).astype(np.int64), MOST_WIDE)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all texts, added up per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            words, counts = [word], [times]
            for _, _, data, offsets in pieces(batch.column("text")):
                found, n = np.unique(word_hashes(data, offsets)[0], return_counts=True)
                words.append(found)
                counts.append(n)
            word, at = np.unique(np.concatenate(words), return_inverse=True)
            times = np.bincount(at, np.concatenate(counts), len(word)).astype(np.int64)
        yield pa.record_batch([pa.array(word.view(np.int64)), pa.array(times)], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word bigint, n bigint")


class Shared:
    """A filter of the words that occur more than once: one bit per word, by the first bits of its hash.

    A word that it does not hold is in one line only, so it links nothing.  It has
    at least 16 bits per word up to ``FILTER_BITS``; with more words it lets more
    of the others pass, which costs rows and changes no result.
    """

    def __init__(self, recurring: DataFrame):
        count = recurring.count()
        self.log = int(np.log2(min(max(count * 16, 64), FILTER_BITS)))
        place = F.shiftrightunsigned("word", 64 - self.log)
        bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(word, {64 - self.log}) & 63 as int))")
        rows = recurring.groupBy(F.shiftrightunsigned(place, 6).alias("cell")).agg(F.bit_or(bit).alias("bits")).toPandas()
        self.cells = np.zeros(1 << (self.log - 6), np.uint64)
        self.cells[rows["cell"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)

    def holds(self, words: np.ndarray) -> np.ndarray:
        place = words >> np.uint64(64 - self.log)
        return (self.cells[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def common_words(recurring: DataFrame, rare: int = RARE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) of the words that make up at least one in ``rare`` of the recurring ones, so at most ``rare`` of them, and their places from the rarest."""
    total = recurring.agg(F.sum("n")).first()[0] or 0
    rows = recurring.filter(F.col("n") * rare >= total).toPandas().sort_values(["n", "word"])
    names = rows["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(names)
    return names[order], order.astype(np.uint64)


def rarity(words: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A key per word that sorts from rare to frequent and is one to one."""
    names, place = common
    key = words >> np.uint64(1)
    if len(names):
        at = np.minimum(np.searchsorted(names, words), len(names) - 1)
        known = names[at] == words
        key[known] = np.uint64(1 << 63) | place[at[known]]
    return key


def line_sets(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], shared: Shared, percent: int, least: int) -> DataFrame:
    """(id, line, node, n, prefix) per line; the prefix, tokens with their places and the parity bits from there on, only once per set and task and without words that occur once."""
    names = ["id", "line", "node", "n", "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column("id")
            for row, _, data, offsets in pieces(batch.column("text")):
                x = Lines(data, offsets, common)
                use = x.size >= least
                for i in np.flatnonzero(use):
                    if (node := int(x.node[i])) in seen:
                        use[i] = False
                    else:
                        seen.add(node)
                keep = np.where(use, x.size - -(-x.size * percent // 100) + 1, 0)
                line = np.repeat(np.arange(len(keep)), keep)
                at = np.arange(len(line)) - np.repeat(np.cumsum(keep) - keep, keep)
                place = x.first[line] + at
                token = x.word[x.rank[place]]
                held = shared.holds(token)
                token, at, line, bits = token[held].view(np.int64), at[held].astype(np.int32), line[held], x.bits[place[held]]
                starts = np.searchsorted(line, np.arange(len(keep) + 1)).astype(np.int32)
                more = x.more_bits(line, at, width(x.size[line], at, percent))
                prefix = pa.StructArray.from_arrays([pa.array(token), pa.array(at), pa.array(bits), more], names=["token", "at", "bits", "more"])
                yield pa.record_batch(
                    [ids.take(pa.array(x.where[0] + row)), pa.array(x.where[1].astype(np.int32)), pa.array(x.node), pa.array(x.size),
                     pa.ListArray.from_arrays(pa.array(starts), prefix)], names=names)

    return docs.select("id", "text").mapInArrow(run, "id bigint, line int, node bigint, n bigint, prefix array<struct<token: bigint, at: int, bits: bigint, more: array<bigint>>>")


def prefix_rows(lines: DataFrame) -> DataFrame:
    """(token, node, size, bits, more): size is packed with the token's place."""
    rows = lines.filter(F.size("prefix") > 0).select("node", "n", F.inline("prefix"))
    return rows.select("token", "node", F.shiftleft("n", 32).bitwiseOR(F.col("at").cast("bigint")).alias("size"), "bits", "more")


def near(size_x, size_y, bits_x, bits_y, percent: int) -> np.ndarray:
    """Length filter and least number of differing words on arrays, for sets whose first shared token is at these places."""
    nx, ny, at_x, at_y = size_x >> 32, size_y >> 32, size_x & 0xFFFFFFFF, size_y & 0xFFFFFFFF
    after = np.maximum(np.bitwise_count((bits_x ^ bits_y).view(np.uint64)).astype(np.int64), np.abs((nx - at_x) - (ny - at_y)))
    return (np.minimum(nx, ny) * 100 >= np.maximum(nx, ny) * percent) & ((at_x + at_y + after) * (100 + percent) <= (nx + ny) * (100 - percent))


def spread_out(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of lists of numbers, 0 for null, and their values in rows of ``MOST_WIDE``, filled up with 0."""
    wide = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    out = np.zeros((len(wide), MOST_WIDE), np.uint64)
    row = np.repeat(np.arange(len(wide)), wide)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(wide) - wide, wide)] = lists.flatten().to_numpy().view(np.uint64)
    return wide, out


def apart(wide_x: np.ndarray, wide_y: np.ndarray, more_x: np.ndarray, more_y: np.ndarray) -> np.ndarray:
    """In how many of their wider parity bits sets differ; bits of the wider one are folded to those of the other."""
    out, least = np.zeros(len(wide_x), np.int64), np.minimum(wide_x, wide_y)
    for w in np.unique(least[least > 0]):
        i = np.flatnonzero(least == w)
        x, y = (np.bitwise_xor.reduce(m[i].reshape(len(i), -1, w), axis=1) for m in (more_x, more_y))
        out[i] = np.bitwise_count(x ^ y).sum(axis=1)
    return out


def candidates(rows: DataFrame, percent: int, most: int, dense: int) -> DataFrame:
    """(x, y) pairs of sets to verify; and, of tokens with more than ``most`` sets or ``dense`` candidates per set, rows (token, x, size, bits, more).

    Reads sorted rows as a stream; what is held of a token is at most ``most`` rows and a batch.
    """
    names, numbers = ["token", "x", "y", "size", "bits", "more"], pa.list_(pa.int64())

    def pairs(x, y):
        none = pa.nulls(len(x), pa.int64())
        return pa.record_batch([none, pa.array(x), pa.array(y), none, none, pa.nulls(len(x), numbers)], names=names)

    def members(token, node, size, bits, wide, more):
        first = np.concatenate(([0], np.cumsum(wide))).astype(np.int32)
        values = more[np.arange(MOST_WIDE) < wide[:, None]].view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(first), pa.array(values), mask=pa.array(wide == 0))
        return pa.record_batch([pa.array(token), pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(size), pa.array(bits), lists], names=names)

    def close(columns):
        """What the complete tokens of these rows give."""
        token, node, size, bits, wide, more = columns
        n = len(token)
        group = np.cumsum(np.concatenate(([0], token[1:] != token[:-1]))) if n else token
        sets = np.bincount(group) if n else group
        full = sets > most
        count, i, d, left, right = np.zeros(len(sets), np.int64), np.arange(n), 0, [], []
        while len(i):
            d += 1
            i = i[i + d < n]
            # sizes ascend within a token, so a set that is too small for one partner is too small for all later ones
            i = i[(group[i] == group[i + d]) & ~full[group[i]] & ((size[i] >> 32) * 100 >= (size[i + d] >> 32) * percent)]
            hit = i[near(size[i], size[i + d], bits[i], bits[i + d], percent) & (node[i] != node[i + d])]
            if len(hit):
                over = apart(wide[hit], wide[hit + d], more[hit], more[hit + d])
                total = (size[hit] >> 32) + (size[hit + d] >> 32)
                before = (size[hit] & 0xFFFFFFFF) + (size[hit + d] & 0xFFFFFFFF)
                hit = hit[(before + over) * (100 + percent) <= total * (100 - percent)]
                left.append(hit)
                right.append(hit + d)
                count += np.bincount(group[hit], minlength=len(sets))
                full |= count > dense * sets
        if left:
            x, y = np.concatenate(left), np.concatenate(right)
            use = ~full[group[x]]
            yield pairs(node[x[use]], node[y[use]])
        if full.any():
            yield members(*[c[full[group]] for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_token = [np.zeros(0, np.int64)] * 5 + [np.zeros((0, MOST_WIDE), np.uint64)], None
        for batch in batches:
            new = [*[batch.column(c).to_numpy() for c in ("token", "node", "size", "bits")], *spread_out(batch.column("more"))]
            if open_token is not None:  # more rows of a token that is too large to be held
                k = int(np.searchsorted(new[0], open_token, "right"))
                if k:
                    yield members(*[c[:k] for c in new])
                new = [c[k:] for c in new]
                if not len(new[0]):
                    continue
                open_token = None
            columns = [np.concatenate((a, b)) for a, b in zip(held, new)]
            if not len(columns[0]):
                continue
            # a set comes once per task that has it
            once = np.concatenate(([True], (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])))
            columns = [c[once] for c in columns]
            last = int(np.searchsorted(columns[0], columns[0][-1]))
            if len(columns[0]) - last > most:
                open_token, last = columns[0][-1], len(columns[0])
            yield from close([c[:last] for c in columns])
            held = [c[last:] for c in columns]
        yield from close(held)

    sorted_ = rows.repartition("token").sortWithinPartitions("token", "size", "node").select("token", "node", "size", "bits", "more")
    return sorted_.mapInArrow(run, "token bigint, x bigint, y bigint, size bigint, bits bigint, more array<bigint>")


def may_match(x: str, y: str, percent: int):
    """As ``near``, on columns size (packed with the token's place), bits and more."""
    nx, ny = (F.shiftright(f"size_{s}", 32) for s in (x, y))
    at_x, at_y = (F.col(f"size_{s}").bitwiseAND(0xFFFFFFFF) for s in (x, y))
    more_x, more_y = F.col(f"more_{x}"), F.col(f"more_{y}")
    w = F.least(F.size(more_x), F.size(more_y))

    def folded(more):
        part = lambda i: F.filter(more, lambda _, k: F.pmod(k, w) == i)
        return F.transform(F.sequence(F.lit(0), w - 1), lambda i: F.aggregate(part(i), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseXOR(b)))

    wider = F.aggregate(F.zip_with(folded(more_x), folded(more_y), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, m: n + m)
    narrow = F.bit_count(F.col(f"bits_{x}").bitwiseXOR(F.col(f"bits_{y}")))

    def within(after):
        return (at_x + at_y + after) * (100 + percent) <= (nx + ny) * (100 - percent)

    return (
        (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent) & within(F.abs((nx - at_x) - (ny - at_y))) & within(narrow.cast("bigint"))
        & F.when(more_x.isNull() | more_y.isNull(), True).otherwise(within(wider.cast("bigint")))
    )


def word_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, words): the sorted word hashes of lines at known places; ``wanted`` has id and lines (numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [[t[i] for i in lines if i < len(t)] for t, lines in zip((x.split("\n") for x in batch.column("text").to_pylist()), batch.column("lines").to_pylist())]
            for _, _, data, offsets in pieces(pa.array([x.replace("\n", " ") for t in texts for x in t], pa.string())):
                x = Lines(data, offsets)
                words = pa.ListArray.from_arrays(pa.array(x.first.astype(np.int32)), pa.array(x.word[x.rank].view(np.int64)))
                yield pa.record_batch([pa.array(x.node), words], names=["node", "words"])

    there = wanted.withColumnRenamed("id", "_id")
    return docs.join(small(there), docs["id"].eqNullSafe(F.col("_id"))).select("text", "lines").mapInArrow(run, "node bigint, words array<bigint>")


def similar(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The later nodes y of pairs (x, y, place_x, place_y) whose word sets have the wanted similarity, written."""
    pairs = written(pairs)
    nodes = pairs.select(F.col("x").alias("node"), F.col("place_x").alias("place")).unionByName(pairs.select(F.col("y").alias("node"), F.col("place_y").alias("place")))
    places = written(nodes.distinct())
    wanted = written(places.groupBy("place.id").agg(F.collect_set("place.line").alias("lines")))
    sets = written(word_sets(docs, wanted).join(places.select("node"), "node", "left_semi").dropDuplicates(["node"]))
    joined = pairs.select("x", "y")
    for side in "xy":
        joined = joined.join(sets.select(F.col("node").alias(side), F.col("words").alias(f"words_{side}")), side)
    both = F.size(F.array_intersect("words_x", "words_y"))
    total = F.size("words_x") + F.size("words_y")
    found = written(joined.filter(both * (100 + percent) >= total * percent).select(F.col("y").alias("node")).distinct())
    deleted(pairs, places, wanted, sets)
    return found


def settled_by(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """Nodes with a similar one at an earlier place, written.  Each is first compared with its earliest candidate, and with the others only if that fails."""
    met = written(pairs)
    nodes = written(met.select(F.explode(F.array("x", "y")).alias("node")).distinct())
    places = small(written(firsts.select("node", "place").join(small(nodes), "node", "left_semi")))
    pairs = met
    for side in "xy":
        pairs = pairs.join(places.select(F.col("node").alias(side), F.col("place").alias(f"place_{side}")), side)
    early = F.col("place_x") < F.col("place_y")
    turned = {"x": "y", "y": "x", "place_x": "place_y", "place_y": "place_x"}
    pairs = written(pairs.select(*[F.when(early, F.col(c)).otherwise(F.col(d)).alias(c) for c, d in turned.items()]))
    first = written(pairs.groupBy("y").agg(F.min(F.struct("place_x", "x", "place_y")).alias("e")).select("e.x", "y", "e.place_x", "e.place_y"))
    found = similar(first, docs, percent)
    rest = pairs.join(small(found).withColumnRenamed("node", "y"), "y", "left_anti").join(small(first).select("x", "y"), ["x", "y"], "left_anti")
    later = similar(rest, docs, percent)
    both = written(found.unionByName(later))
    deleted(met, nodes, places, pairs, first, found, later)
    return both


def matched_lines(docs: DataFrame, percent: int = PERCENT, least: int = MIN_WORDS) -> DataFrame:
    """(id, line) of every line that goes, written; ``docs`` has id and text.  What else is written is deleted after its last reader."""
    # each task has a word once, so adding up before the shuffle would save nothing
    recurring = written(word_counts(docs).repartition("word").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1"))
    common, shared = common_words(recurring), Shared(recurring)
    deleted(recurring)
    lines = written(line_sets(docs, common, shared, percent, least))
    place = F.struct("id", "line")
    firsts = written(lines.filter(F.col("n") >= least).groupBy("node").agg(F.min(place).alias("place"), F.count("*").alias("lines")))
    made = written(candidates(prefix_rows(lines), percent, HELD, DENSE))
    hot = made.filter("token is not null").select("token", "x", F.col("size").alias("size_x"), F.col("bits").alias("bits_x"), F.col("more").alias("more_x")).distinct()
    hot = written(hot.join(firsts.select(F.col("node").alias("x"), "place"), "x"))
    lead = hot.groupBy("token").agg(F.min_by(F.struct("x", "size_x", "bits_x", "more_x"), F.struct("place", "x")).alias("y"))
    lead = lead.select("token", F.col("y.x").alias("y"), F.col("y.size_x").alias("size_y"), F.col("y.bits_x").alias("bits_y"), F.col("y.more_x").alias("more_y"))
    star = hot.drop("place").join(lead, "token").filter((F.col("x") != F.col("y")) & may_match("x", "y", percent))
    first = made.filter("token is null").select("x", "y").unionByName(star.select("x", "y"))
    first = first.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    settled = settled_by(first, docs, firsts, percent)
    deleted(made)
    # a set of a hot token that is not settled meets the others of the token
    mine = hot.join(settled.withColumnRenamed("node", "x"), "x", "left_anti").select("token", "x", "size_x", "bits_x", "more_x")
    others = hot.select("token", F.col("x").alias("y"), F.col("size_x").alias("size_y"), F.col("bits_x").alias("bits_y"), F.col("more_x").alias("more_y"))
    pairs = mine.join(others, "token").filter((F.col("x") != F.col("y")) & may_match("x", "y", percent))
    pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    settled = settled.unionByName(settled_by(pairs, docs, firsts, percent)).distinct()
    deleted(hot)
    # lines after the first of their set, and the first ones of settled sets
    repeated = firsts.filter("lines > 1").select("node", "place")
    gone = settled.select("node", F.lit(True).alias("gone"))
    known = written(repeated.join(gone, "node", "full").select("node", "place", F.coalesce("gone", F.lit(False)).alias("gone")))
    met = lines.filter(F.col("n") >= least).join(small(known), "node")
    out = written(met.filter(F.col("gone") | (F.struct("id", "line") > F.col("place"))).select("id", "line"))
    deleted(lines, firsts, known)
    return out


def without_similar_lines(docs: DataFrame, percent: int = PERCENT, least: int = MIN_WORDS, id_column: str = "doc_id", text_column: str = "text",
                          kept: str = "kept_text", removed: str = "removed_lines") -> DataFrame:
    """The rows of ``docs`` with two more columns, the kept text and the numbers (from 0) of removed lines; they replace any of those names."""
    docs = docs.drop(kept, removed)
    rows = docs.select(docs[id_column].cast("bigint").alias("id"), text_of(docs, text_column).alias("text"))
    whose = fresh(docs, "gone_id")
    gone = written(matched_lines(rows, percent, least).groupBy(F.col("id").alias(whose)).agg(F.array_sort(F.collect_set("line")).alias(removed)))
    out = docs.join(small(gone), docs[id_column].cast("bigint").eqNullSafe(F.col(whose)), "left").drop(whose)
    lines, text = F.split(text_of(out, text_column), "\n"), out[text_column]
    out = out.withColumn(removed, F.coalesce(removed, F.array().cast("array<int>")))
    left = F.concat_ws("\n", F.filter(lines, lambda x, i: ~F.array_contains(removed, i)))
    return out.withColumn(kept, F.when(F.size(removed) == 0, text).otherwise(left))
