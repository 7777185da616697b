"""Small Arrow kernels.  They are pickled by value, so executors need no copy of this package."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def pack_vectors(key_names, most=None):
    """mapInArrow function: one row per run of equal keys in a batch, of at most ``most`` vectors, packed into bytes."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows == 0:
                continue
            vec = batch.column("vec")
            flat = np.asarray(vec.flatten()).astype(np.float32, copy=False)
            mat = flat.reshape(batch.num_rows, -1)
            ids = np.asarray(batch.column("id")).astype(np.int64)
            codes = np.zeros(batch.num_rows, np.int64)
            for k in key_names:
                coded = batch.column(k).dictionary_encode()
                codes = codes * (len(coded.dictionary) + 1) + np.asarray(coded.indices.fill_null(len(coded.dictionary)))
            order = np.lexsort((ids, codes))
            first = np.flatnonzero(np.concatenate(([True], codes[order][1:] != codes[order][:-1])))
            if most:
                ends = np.append(first[1:], len(order))
                first = np.concatenate([np.arange(a, b, most) for a, b in zip(first, ends)])
            parts = np.split(order, first[1:])
            out = {
                **{k: batch.column(k).take(pa.array(order[first])) for k in key_names},
                "ids": [ids[ix].tobytes() for ix in parts],
                "mat": [mat[ix].tobytes() for ix in parts],
            }
            yield pa.RecordBatch.from_pydict(out)

    return run


def centroids_of(rows, n, rounds):
    """At most ``n`` centers of the rows: some rounds of moving each center to the mean of its nearest rows."""
    import numpy as np

    if not len(rows):
        return np.zeros((0, 0))
    centers = np.unique(rows, axis=0)
    centers = centers[np.linspace(0, len(centers) - 1, min(n, len(centers))).astype(int)]
    for _ in range(rounds):
        near = ((centers * centers).sum(1)[None, :] - 2 * rows @ centers.T).argmin(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, rows)
        counts = np.bincount(near, minlength=len(centers))
        centers[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centers


def nearest_centroid(centers):
    """mapInArrow function: adds the nearest center of each vector and the distance to it."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows == 0:
                continue
            mat = np.asarray(batch.column("vec").flatten()).astype(np.float64).reshape(batch.num_rows, -1)
            near = ((centers * centers).sum(1)[None, :] - 2 * mat @ centers.T).argmin(1)
            radius = np.sqrt(((mat - centers[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("collection"), batch.column("chunk_id"), batch.column("vec"), pa.array(near.astype(np.int32)), pa.array(radius)],
                names=["collection", "chunk_id", "vec", "centroid", "radius"])

    return run


def ring_blocks(most):
    """mapInArrow function over rows in order of (centroid, collection, radius): packed blocks with their radii."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = np.asarray(batch.column("chunk_id"))
            mat = np.asarray(batch.column("vec").flatten()).astype(np.float32).reshape(batch.num_rows, -1)
            centroid, radius = np.asarray(batch.column("centroid")), np.asarray(batch.column("radius"))
            coded = batch.column("collection").dictionary_encode()
            code = np.asarray(coded.indices.fill_null(len(coded.dictionary)))
            new = np.flatnonzero((centroid[1:] != centroid[:-1]) | (code[1:] != code[:-1])) + 1
            edges = [0, *new.tolist(), batch.num_rows]
            spans = [(i, min(i + most, b)) for a, b in zip(edges, edges[1:]) for i in range(a, b, most)]
            starts = pa.array([a for a, _ in spans])
            order = [np.arange(a, b)[np.argsort(ids[a:b], kind="stable")] for a, b in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column("collection").take(starts), batch.column("centroid").take(starts),
                 pa.array(number + np.arange(len(spans))), pa.array(np.array([b - a for a, b in spans], np.int32)),
                 pa.array([float(radius[a:b].min()) for a, b in spans]), pa.array([float(radius[a:b].max()) for a, b in spans]),
                 pa.array([ids[o].tobytes() for o in order], pa.binary()), pa.array([mat[o].tobytes() for o in order], pa.binary())],
                names=["collection", "centroid", "block", "n", "low", "high", "ids", "mat"])
            number += len(spans)

    return run


def _ring_floors(centers, rings, mat):
    """(questions x rings): how near a vector of the ring can be at least."""
    import numpy as np

    gap = np.sqrt(np.maximum((mat * mat).sum(1)[:, None] + (centers * centers).sum(1)[None, :] - 2 * mat @ centers.T, 0))
    gap = gap[:, rings["centroid"]]
    # the square root of a difference loses half the digits
    return np.maximum(np.maximum(gap - rings["high"], rings["low"] - gap) - 1e-6, 0)


def _rings_by_collection(held):
    import numpy as np

    groups = {}
    for i, c in enumerate(held["collection"]):
        groups.setdefault(c, []).append(i)
    arrays = {c: np.array(held[c]) for c in ("centroid", "block", "n", "low", "high")}
    return [(c, {name: x[rows] for name, x in arrays.items()}) for c, rows in groups.items()]


def _ring_rows(ids, collection, rings, row, column, floors, kind):
    import numpy as np
    import pyarrow as pa

    return pa.RecordBatch.from_arrays(
        [pa.array(ids[row]), pa.array([collection] * len(row), kind), pa.array(rings["centroid"][column].astype(np.int32)),
         pa.array(rings["block"][column].astype(np.int64)), pa.array(rings["n"][column].astype(np.int32)), pa.array(floors[row, column])],
        names=["question_id", "collection", "centroid", "block", "n", "floor"])


def nearest_rings(centers, held, k, kind):
    """mapInArrow function over questions: per question and collection the rings that can be nearest, until they hold k vectors."""

    def run(batches):
        import numpy as np

        groups = _rings_by_collection(held.value)
        for batch in batches:
            ids = np.asarray(batch.column("question_id")).astype(np.int64)
            mat = np.asarray(batch.column("vec").flatten()).astype(np.float64).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
            for collection, rings in groups:
                step = max(1, 1_000_000 // len(rings["block"]))
                for at in range(0, len(ids), step):
                    floors = _ring_floors(centers, rings, mat[at : at + step])
                    order = np.lexsort((np.broadcast_to(rings["block"], floors.shape), floors), axis=1)[:, :k]
                    sizes = rings["n"][order]
                    row, place = np.nonzero(np.cumsum(sizes, axis=1) - sizes < k)
                    yield _ring_rows(ids[at : at + step], collection, rings, row, order[row, place], floors, kind)

    return run


def rings_within(centers, held):
    """mapInArrow function over (question_id, collection, reach, vec): the rings of the collection that may hold something within reach."""

    def run(batches):
        import numpy as np

        groups = _rings_by_collection(held.value)
        for batch in batches:
            ids = np.asarray(batch.column("question_id")).astype(np.int64)
            if not len(ids):
                continue
            mat = np.asarray(batch.column("vec").flatten()).astype(np.float64).reshape(len(ids), -1)
            reach, names = np.asarray(batch.column("reach")), np.array(batch.column("collection").to_pylist(), object)
            for collection, rings in groups:
                mine = np.flatnonzero(names == collection)
                step = max(1, 1_000_000 // len(rings["block"]))
                for at in range(0, len(mine), step):
                    some = mine[at : at + step]
                    floors = _ring_floors(centers, rings, mat[some])
                    row, column = np.nonzero(floors <= reach[some][:, None])
                    yield _ring_rows(ids[some], collection, rings, row, column, floors, batch.column("collection").type)

    return run


def within_reach(centers, held, k, dim, most):
    """mapInArrow function over blocks (collection, centroid, low, high, ids, mat): the nearest vectors within reach of the held questions.

    ``held`` has the ids and vectors of some questions and, by collection, how far each of
    them has to look.  A block is compared with the questions whose reach its ring meets,
    and a task keeps the k nearest per question and gives them out at its end.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids, mat, reach_of = held.value
        q_ids = np.frombuffer(ids, np.int64)
        q = np.frombuffer(mat, np.float32).reshape(-1, dim).astype(np.float64)
        gap = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (centers * centers).sum(1)[None, :] - 2 * q @ centers.T, 0)).T.copy()
        best, reaches, kind = {}, {}, None
        for batch in batches:
            kind = batch.column("collection").type
            centroid, low, high = (np.asarray(batch.column(c)) for c in ("centroid", "low", "high"))
            for i, name in enumerate(batch.column("collection").to_pylist()):
                if name not in reach_of:
                    continue
                if name not in best:
                    reaches[name] = np.frombuffer(reach_of[name], np.float64)
                    best[name] = _Nearest(k, np.where(reaches[name] < 0, -1.0, reaches[name] ** 2))
                # the square root of a difference loses half the digits
                away = gap[centroid[i]]
                use = np.flatnonzero(np.maximum(np.maximum(away - high[i], low[i] - away) - 1e-6, 0) <= reaches[name])
                if not len(use):
                    continue
                chunk = np.frombuffer(batch.column("ids")[i].as_buffer(), np.int64)
                m = np.frombuffer(batch.column("mat")[i].as_buffer(), np.float32).reshape(-1, dim).astype(np.float64)
                for at in range(0, len(use), most):
                    some = use[at : at + most]
                    row, col, dist = _near(q[some], m, k, best[name].far[some])
                    best[name].add(some[row], chunk[col], dist)
        for name, kept in best.items():
            row, chunk, dist = kept.rows()
            yield pa.RecordBatch.from_arrays(
                [pa.array(q_ids[row]), pa.array([name] * len(row), kind), pa.array(chunk), pa.array(dist)],
                names=["question_id", "collection", "chunk_id", "distance"])

    return run


class _Nearest:
    """The k nearest (row, chunk, distance) per row among those added, by distance and then chunk; ``far`` is how far a row has to look."""

    def __init__(self, k, far):
        import numpy as np

        self.k, self.far, self.waiting, self.n = k, far, [], 0
        self.held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def add(self, row, chunk, dist):
        if len(row):
            self.waiting.append((row, chunk, dist))
            self.n += len(row)
            if self.n > max(1 << 18, len(self.held[0]) // 2):
                self.rows()

    def rows(self):
        import numpy as np

        row, chunk, dist = (np.concatenate(x) for x in zip(self.held, *self.waiting))
        order = np.lexsort((chunk, dist, row))
        r = row[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        last = order[place == self.k - 1]
        order = order[place < self.k]
        self.far[row[last]] = np.minimum(self.far[row[last]], dist[last])
        self.held, self.waiting, self.n = (row[order], chunk[order], dist[order]), [], 0
        return self.held


def _near(q, m, k, far):
    """Rows, columns and squared distances of the vectors of ``m`` (in order of their ids) within ``far`` of every row of ``q``: the k nearest, or some more."""
    import numpy as np

    q_size, m_size = (q * q).sum(1), (m * m).sum(1)
    scale = q_size.max(initial=0.0) + m_size.max(initial=0.0)
    if scale <= 64.0:
        # one product in single precision tells by how much a distance is beyond ``far``; those that may be within it are measured in double
        reach = np.minimum(far, 4.0 * scale + 1.0)  # no distance is larger than twice the scale
        beyond = np.column_stack([-2.0 * q, q_size - reach, np.ones(len(q))]).astype(np.float32) @ np.column_stack([m, np.ones(len(m)), m_size]).astype(np.float32).T
        row, col = np.divmod(np.flatnonzero(beyond <= 4e-5 * (scale + 1.0)), max(len(m), 1))
    else:  # values of this size are measured together
        dist = q_size[:, None] + m_size[None, :] - 2.0 * (q @ m.T)
        row, col = np.nonzero(dist <= (far + 1e-8)[:, None])
    if len(row) > 2 * k * len(q):
        row, col, dist = _nearest(q, m, k)
        return row, col, dist[row, col]
    if scale <= 64.0:
        near = q_size[row] + m_size[col] - 2.0 * np.einsum("ij,ij->i", q[row], m[col])
        within = near <= far[row] + 1e-8
        row, col, near = row[within], col[within], near[within]
    else:
        near = dist[row, col]
    return row, col, np.round(np.maximum(near, 0.0), 9)


def _nearest(q, m, k):
    """Rows and columns of the k nearest vectors of ``m`` (in order of their ids) to every row of ``q``, and all squared distances."""
    import numpy as np

    dist = (q * q).sum(1)[:, None] + (m * m).sum(1)[None, :] - 2.0 * (q @ m.T)
    dist = np.round(np.maximum(dist, 0.0), 9)
    # ids are in order, so equal distances come out by id
    take = min(k, len(m))
    limit = np.partition(dist, take - 1, axis=1)[:, take - 1]
    row, col = np.nonzero(dist <= limit[:, None])
    near = np.lexsort((col, dist[row, col], row))
    row, col = row[near], col[near]
    start = np.searchsorted(row, np.arange(len(q)))
    kept = np.arange(len(row)) - start[row] < take
    return row[kept], col[kept], dist


def nearest_in_blocks(k, key_names, dim):
    """mapInArrow function over (question block, vector block) rows.

    Emits the k nearest vectors per question of every block pair, never all pairs.
    Distances are squared Euclidean, computed in double precision.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in key_names + ["q_ids", "q_mat", "ids", "mat"]}
            out = {n: [] for n in ["question_id", *key_names, "chunk_id", "distance"]}
            for r in range(batch.num_rows):
                q_ids = np.frombuffer(cols["q_ids"][r], dtype=np.int64)
                ids = np.frombuffer(cols["ids"][r], dtype=np.int64)
                q = np.frombuffer(cols["q_mat"][r], dtype=np.float32).reshape(-1, dim).astype(np.float64)
                m = np.frombuffer(cols["mat"][r], dtype=np.float32).reshape(-1, dim).astype(np.float64)
                row, col, dist = _nearest(q, m, k)
                out["question_id"].append(q_ids[row])
                for n in key_names:
                    out[n].extend([cols[n][r]] * len(row))
                out["chunk_id"].append(ids[col])
                out["distance"].append(dist[row, col])
            if not out["question_id"]:
                continue
            out.update({n: pa.array(out[n], batch.column(n).type) for n in key_names})
            for n in ("question_id", "chunk_id", "distance"):
                out[n] = pa.array(np.concatenate(out[n]))
            yield pa.RecordBatch.from_pydict(out)

    return run


PIECE = 1024
KEPT = 1 << 23


def nearest_to_held(held, k, key, dim):
    """mapInArrow function over vectors (key, id, vec): pieces of a batch meet all held question blocks; a task gives out k per question and key.

    A matrix of distances has at most PIECE rows and a block's columns.  Beyond
    KEPT hits of different keys, those of one key are given out early.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        blocks = held.value
        q_ids = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(i, np.int64) for i, _ in blocks]])
        best, names = {}, {}

        def given(c):
            row, chunk, dist = best.pop(c).rows()
            return pa.RecordBatch.from_arrays(
                [pa.array(q_ids[row]), names[c].take(pa.array(np.zeros(len(row), np.int64))), pa.array(chunk), pa.array(dist)],
                names=["question_id", key, "chunk_id", "distance"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            flat = np.asarray(batch.column("vec").flatten()).astype(np.float32, copy=False).reshape(batch.num_rows, -1)
            ids = np.asarray(batch.column("id")).astype(np.int64)
            coded = batch.column(key).dictionary_encode()
            code = np.asarray(coded.indices.fill_null(len(coded.dictionary)))
            for x in np.unique(code):
                mine = np.flatnonzero(code == x)
                name = batch.column(key).take(pa.array(mine[:1]))
                c = name[0].as_py()
                if c not in best:
                    while best and (len(best) + 1) * len(q_ids) * k > KEPT:
                        yield given(next(iter(best)))
                    names[c], best[c] = name, _Nearest(k, np.full(len(q_ids), np.inf))
                for at in range(0, len(mine), PIECE):
                    some = mine[at : at + PIECE]
                    some = some[np.argsort(ids[some], kind="stable")]
                    m, start = flat[some].astype(np.float64), 0
                    for i, mat in blocks:
                        end = start + len(i) // 8
                        row, col, dist = _near(np.frombuffer(mat, np.float32).reshape(-1, dim).astype(np.float64), m, k, best[c].far[start:end])
                        best[c].add(start + row, ids[some][col], dist)
                        start = end
        while best:
            yield given(next(iter(best)))

    return run


WORD_START = "\x01"
PAIRS_AT_ONCE = 1 << 20
SIGNATURES = 1 << 16
TERMS_AT_ONCE = 1 << 18
ENTRIES_AT_ONCE = 1 << 16
NO_KEY = -(1 << 63) + 1


def _patterns(column, ids, mark=""):
    """(question, pattern) of a list column, patterns numbered in ``ids``; null and empty ones are none."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    coded = pc.list_flatten(column).dictionary_encode()
    number = np.array([ids.setdefault(mark + p, len(ids)) if p else -1 for p in coded.dictionary.to_pylist()] + [-1], np.int64)
    code = number[np.asarray(coded.indices.fill_null(len(number) - 1)).astype(np.int64)]
    use = code >= 0
    return np.asarray(pc.list_parent_indices(column)).astype(np.int64)[use], code[use]


def _automaton(ids):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for pattern, i in ids.items():
        automaton.add_word(pattern, i)
    if ids:
        automaton.make_automaton()
    return automaton if ids else None


def _within(values, automaton):
    """(place of the value, pattern) for every pattern inside a value, each once; equal values are read once."""
    import numpy as np

    coded = values.dictionary_encode()
    lists = [sorted({p for _, p in automaton.iter(v)}) if v else [] for v in coded.dictionary.to_pylist()]
    sizes = np.array([len(x) for x in lists], np.int64)
    flat = np.array([p for x in lists for p in x], np.int64)
    there = np.flatnonzero(np.asarray(coded.is_valid()))
    code = np.asarray(coded.indices.fill_null(0)).astype(np.int64)[there]
    each, at = _ranges((np.cumsum(sizes) - sizes)[code], sizes[code])
    return there[each], flat[at]


def _ranges(start, size):
    """Number of the range and place for every place of the ranges start .. start + size."""
    import numpy as np

    each = np.repeat(np.arange(len(size)), size)
    return each, np.arange(len(each)) - (np.cumsum(size) - size)[each] + start[each]


def _best_pairs(question, row, points, limit):
    """Places of the first ``limit`` pairs per question: most points first, then the first row."""
    import numpy as np

    order = np.lexsort((row, -points, question))
    q = question[order]
    first = np.searchsorted(q, q)
    return order[np.arange(len(q)) - first < limit]


def _counted(row, pattern, width):
    """(row, pattern, number) of repeated matches, in order."""
    import numpy as np

    key, n = np.unique(row * width + pattern, return_counts=True)
    return key // width, key % width, n.astype(np.float64)


class _Search:
    """The best rows per question by the sum of weight x value over the patterns that a row holds, across the batches of a task.

    A question has entries (pattern, weight).  What it has found so far is a
    floor: only those of its patterns are looked up in a batch without which no
    row can come up to the floor, its rarest ones first.
    """

    def __init__(self, question, pattern, weight, n_questions, n_patterns, limit, need=None, digits=None, valid=None):
        import numpy as np

        self.entries, self.n, self.n_patterns, self.limit = (question, pattern, weight.astype(np.float64)), n_questions, max(1, n_patterns), limit
        self.need, self.digits, self.valid, self.slack = need, digits, valid, 0 if digits is None else 2 * 10.0**-digits
        # with ``need`` the score has to be just that
        self.score = np.zeros((n_questions, limit)) if need is None else np.repeat(need.astype(np.float64)[:, None], limit, 1)
        self.key = np.full((n_questions, limit), -(1 << 63) if need is None else (1 << 63) - 1, np.int64)

    def _good(self, q, score, key):
        floor, last = self.score[q, -1], self.key[q, -1]
        return (score > floor) | ((score == floor) & (key <= last))

    def _learn(self, q, score, key):
        """``q`` is in order, with at most ``limit`` rows each."""
        import numpy as np

        touched = np.unique(q)
        every = np.concatenate([q, np.repeat(touched, self.limit)])
        score, key = np.concatenate([score, self.score[touched].ravel()]), np.concatenate([key, self.key[touched].ravel()])
        order = np.lexsort((key, -score, every))
        each = every[order]
        order = order[np.arange(len(each)) - np.searchsorted(each, each) < self.limit]
        self.score[touched], self.key[touched] = score[order].reshape(-1, self.limit), key[order].reshape(-1, self.limit)

    def best(self, row, pattern, value, key, allowed=None):
        """(question, row, score) of a batch; matches (row, pattern, value) are in order, and rows in order of ``key``."""
        import numpy as np

        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if not len(row):
            return nothing
        width = self.n_patterns
        seen = np.bincount(pattern, minlength=width)
        use = seen[self.entries[1]] > 0
        if allowed is not None:
            use &= allowed[self.entries[0]]
        q, p, w = (x[use] for x in self.entries)
        if not len(q):
            return nothing
        most = np.zeros(width)
        np.maximum.at(most, pattern, value)
        order = np.lexsort((p, seen[p], q))
        q, p, w = q[order], p[order], w[order]
        gain = w * most[p]
        before = np.cumsum(gain) - gain
        own = np.searchsorted(q, q)
        # the most that a row can have whose rarest pattern of the question is this one
        rest = np.bincount(q, weights=gain, minlength=self.n)[q] - (before - before[own])
        q_start = np.searchsorted(q, np.arange(self.n + 1))
        by_pattern = np.argsort(p, kind="stable")
        owners = np.bincount(p, minlength=width)
        start = np.cumsum(owners) - owners
        place = row * width + pattern
        a_question = 1 + len(q) / max(1, len(np.unique(q)))
        n_rows, low, out = len(key), 0, []
        while low < n_rows:
            floor, last = self.score[q, -1], self.key[q, -1]
            wanted = rest >= floor - self.slack if self.slack else (rest > floor) | ((rest == floor) & (key[low] <= last))
            if not wanted.any():
                break
            some = by_pattern[wanted[by_pattern]]
            n_some = np.bincount(p[some], minlength=width)
            a = np.searchsorted(row, low)
            whole, part = owners[pattern[a:]], n_some[pattern[a:]]
            looked_up = part.sum() * a_question < whole.sum()
            work = np.cumsum(np.bincount(row[a:] - low, weights=part * a_question if looked_up else whole, minlength=n_rows - low))
            high = min(low + max(1, int(np.searchsorted(work, PAIRS_AT_ONCE, side="right"))), n_rows)
            b = np.searchsorted(row, high)
            size = n_some if looked_up else owners
            each, at = _ranges((np.cumsum(size) - size)[pattern[a:b]], size[pattern[a:b]])
            entry = (some if looked_up else by_pattern)[at]
            pair = q[entry] * (high - low) + (row[a:b] - low)[each]
            if looked_up:
                pair = np.unique(pair)
                pq, pr = pair // (high - low), pair % (high - low) + low
                each, at = _ranges(q_start[pq], (q_start[1:] - q_start[:-1])[pq])
                find = pr[each] * width + p[at]
                there = np.minimum(np.searchsorted(place, find), len(place) - 1)
                score = np.bincount(each, weights=np.where(place[there] == find, w[at] * value[there], 0.0), minlength=len(pair))
            else:
                points = w[entry] * value[a:b][each]
                if self.n * (high - low) <= 4 * len(pair) + PAIRS_AT_ONCE:
                    score = np.bincount(pair, weights=points, minlength=self.n * (high - low))
                    pair = np.flatnonzero(score)
                    score = score[pair]
                else:
                    pair, back = np.unique(pair, return_inverse=True)
                    score = np.bincount(back, weights=points, minlength=len(pair))
                pq, pr = pair // (high - low), pair % (high - low) + low
            if self.digits is not None:
                score = np.round(score, self.digits)
            use = self._good(pq, score, key[pr])
            if self.need is not None:
                use &= score == self.need[pq]
            if self.valid is not None:
                use &= self.valid(pq, score)
            pq, pr, score = pq[use], pr[use], score[use]
            mine = _best_pairs(pq, pr, score, self.limit)
            if len(mine):
                pq, pr, score = pq[mine], pr[mine], score[mine]
                self._learn(pq, score, key[pr])
                out.append((pq, pr, score))
            low = high
        if not out:
            return nothing
        q, r, score = (np.concatenate(x) for x in zip(*out))
        use = np.flatnonzero(self._good(q, score, key[r]))
        mine = use[_best_pairs(q[use], r[use], score[use], self.limit)]
        return q[mine], r[mine], score[mine]


class _Alike:
    """Rows with equal matches are equal to every question, so of each kind only the first ``limit`` rows by key are of use."""

    def __init__(self, limit):
        self.limit, self.known = limit, {}

    def first(self, row, code, keys, n_rows):
        """Which rows may be among the first; matches (row, code) are in order."""
        import numpy as np
        from bisect import insort

        use = np.zeros(n_rows, bool)
        rows, start = np.unique(row, return_index=True)
        ends = np.append(start[1:], len(row))
        code = code.astype(np.int64)
        for r, a, b in zip(rows.tolist(), start.tolist(), ends.tolist()):
            kind = code[a:b].tobytes()
            held = self.known.get(kind)
            if held is None:
                use[r] = True
                if len(self.known) < SIGNATURES:
                    self.known[kind] = [keys[r]]
            elif len(held) < self.limit or keys[r] < held[-1]:
                use[r] = True
                insort(held, keys[r])
                del held[self.limit :]
        return use


def _keys(num, row_id):
    """Sortable keys of rows, null first, and their whole-number part."""
    import numpy as np

    nums = num.to_pylist()
    keys = [(n is not None, n or 0, r is not None, r or "") for n, r in zip(nums, row_id.to_pylist())]
    return keys, np.array([NO_KEY if n is None else max(n, NO_KEY) for n in nums], np.int64)


def table_hits(held, layout, limit, ranked, parts):
    """mapInArrow function over rows (t, num, row_id, texts, words) of the tables in ``layout`` (label, number of text columns, place of the name).

    Gives the best rows per set of patterns, table and task: by word search (kind 0), and by
    substring search (kind 1) for sets without a word hit so far.  Automata find all
    patterns of the held sets in one pass over each different text.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        asked = held.value
        n, ids = asked.num_rows, np.asarray(asked.column("set_id"))
        stem_ids, text_ids = {}, {}
        stems = _patterns(asked.column("stems"), stem_ids, WORD_START)
        terms, phrases = _patterns(asked.column("terms"), text_ids), _patterns(asked.column("phrases"), text_ids)
        n_stems = np.array([len(x or ()) for x in asked.column("stems").to_pylist()], np.int64)
        n_words, n_texts = len(stem_ids), max(1, len(text_ids))
        words_in, texts_in = _automaton(stem_ids), _automaton(text_ids)
        routed = asked.column("tables").to_pylist() if "tables" in asked.column_names else None
        nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        searches, alike, met = {}, {}, {}

        def by_words():
            # a row without any stem is no hit; the other points are tens of stems
            question = np.concatenate([stems[0], terms[0], phrases[0]])
            pattern = np.concatenate([stems[1], n_words + terms[1], n_words + n_texts + phrases[1]])
            weight = np.concatenate([np.ones(len(stems[0])), 50 * n_stems[terms[0]], 20 * n_stems[phrases[0]]])
            return _Search(question, pattern, weight, n, n_words + 2 * n_texts, limit, valid=lambda q, v: v % np.maximum(10 * n_stems[q], 1) > 0)

        def by_parts():
            weight = np.concatenate([np.ones(len(terms[0])), np.full(len(phrases[0]), 10)])
            return _Search(np.concatenate([terms[0], phrases[0]]), np.concatenate([terms[1], phrases[1]]), weight, n, n_texts, limit)

        for batch in batches:
            for t in np.unique(np.asarray(batch.column("t"))):
                label, n_own, name = layout[t]
                rows = pa.Table.from_batches([batch]).filter(pc.equal(pc.field("t"), int(t)))
                rows = rows.take(pc.sort_indices(rows, [("num", "ascending"), ("row_id", "ascending")], null_placement="at_start")).combine_chunks()
                if t not in searches:
                    searches[t], alike[t] = (by_words(), by_parts()), _Alike(limit)
                    met[t] = np.array([label in x for x in routed]) if routed is not None else np.ones(n, bool), np.zeros(n, bool)
                allowed, found = met[t]
                texts = pa.concat_arrays(rows.column("texts").chunks)
                width = len(texts.flatten()) // len(texts)
                place, pattern = _within(texts.flatten(), texts_in) if texts_in else nothing
                row, slot = place // width, place % width
                worded = ranked and name is not None and words_in is not None
                w_row, w_pattern = _within(pa.concat_arrays(rows.column("words").chunks), words_in) if worded else nothing
                every, code = np.concatenate([row, w_row]), np.concatenate([slot * n_texts + pattern, width * n_texts + w_pattern])
                order = np.lexsort((code, every))
                keys, key = _keys(*(pa.concat_arrays(rows.column(c).chunks) for c in ("num", "row_id")))
                use = alike[t].first(every[order], code[order], keys, len(texts))
                row, slot, pattern = (x[use[row]] for x in (row, slot, pattern)) if len(row) else (row, slot, pattern)
                w_row, w_pattern = (x[use[w_row]] for x in (w_row, w_pattern)) if len(w_row) else (w_row, w_pattern)
                own = slot < n_own
                row_n, pattern_n, value_n = _counted(row[own], pattern[own], n_texts)
                out = []
                if worded:
                    named = slot == name
                    every, code = np.concatenate([w_row, row[named], row_n]), np.concatenate([w_pattern, n_words + pattern[named], n_words + n_texts + pattern_n])
                    value = np.concatenate([np.ones(len(w_row) + int(named.sum())), value_n])
                    order = np.lexsort((code, every))
                    out.append((0, *searches[t][0].best(every[order], code[order], value[order], key, allowed)))
                    found[out[0][1]] = True
                if parts:
                    out.append((1, *searches[t][1].best(row_n, pattern_n, value_n, key, allowed & ~found)))
                for kind, q, r, points in out:
                    points, ten = points.astype(np.int64), np.maximum(10 * n_stems[q], 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[q]), pa.array(np.full(len(q), t, np.int32)), *[pa.concat_arrays(rows.column(c).chunks).take(pa.array(r)) for c in ("num", "row_id")],
                         pa.array(np.full(len(q), kind, np.int32)), pa.array(points % ten if kind == 0 else points), pa.array(n_stems[q]),
                         pa.array(points // ten * 10 if kind == 0 else np.zeros(len(q), np.int64))],
                        names=["set_id", "t", "num", "row_id", "kind", "n_found", "n_stems", "extra"])

    return run


def list_hits(held, limit):
    """mapInArrow function over rows (table, row_id, found), where ``found`` lists the patterns of a row, with repeats.

    Gives the best rows per held set (set_id, patterns, weights, need), table and
    task, equal scores by the length of the row id and the id; where ``need`` is
    given the score has to be just that.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        asked = held.value
        n, ids, known = asked.num_rows, np.asarray(asked.column("set_id")), {}
        question, pattern = _patterns(asked.column("patterns"), known)
        weight = np.array([w for ps, ws in zip(asked.column("patterns").to_pylist(), asked.column("weights").to_pylist()) for p, w in zip(ps, ws) if p], np.float64)
        need = asked.column("need").to_pylist()
        need = None if any(x is None for x in need) else np.array(need, np.float64)
        searches, alike = {}, {}
        for batch in batches:
            labels = np.array(batch.column("table").to_pylist(), object)
            for label in dict.fromkeys(labels.tolist()):
                rows = batch.take(pa.array(np.flatnonzero(labels == label)))
                names = rows.column("row_id").to_pylist()
                keys = [(x is not None, len(x or ""), (x or "").encode()) for x in names]
                order = sorted(range(len(keys)), key=keys.__getitem__)
                rows, keys = rows.take(pa.array(order)), [keys[i] for i in order]
                # length and first bytes in one number, in the order of the keys
                key = np.array([min(k[1], 1 << 14) << 48 | int.from_bytes(k[2][:6].ljust(6, b"\0"), "big") if k[0] else NO_KEY for k in keys], np.int64)
                fresh = dict(known)
                row, code = _patterns(rows.column("found"), fresh)
                row, code = row[code < len(known)], code[code < len(known)]
                if not len(row):
                    continue
                if label not in searches:
                    searches[label], alike[label] = _Search(question, pattern, weight, n, len(known), limit, need), _Alike(limit)
                order = np.lexsort((code, row))
                use = alike[label].first(row[order], code[order], keys, len(keys))
                row, code, value = _counted(row[use[row]], code[use[row]], len(known))
                q, r, score = searches[label].best(row, code, value, key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[q]), *[rows.column(c).take(pa.array(r)) for c in ("table", "row_id")], pa.array(score)], names=["set_id", "table", "row_id", "score"])

    return run


def _by_entries(batches, column, most):
    """Batches cut into slices whose lists of ``column`` have at most ``most`` entries together; one row at least."""
    import numpy as np

    for batch in batches:
        lists, low = batch.column(column), 0
        ends = np.asarray(lists.offsets)[1:].astype(np.int64)
        while low < batch.num_rows:
            before = int(np.asarray(lists.offsets)[low])
            high = max(low + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(low, high - low)
            low = high


def ranked_chunks(held, limit, k1, b, kind):
    """mapInArrow function over chunks (collection, chunk_id, n_tokens, terms <term, tf>): the best chunks per held set of terms, collection and task.

    ``held`` has the sets (set_id, terms <term, qtf>) and the weights (collection, term, weight, avg_tokens) of their terms.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        asked, weights = held.value
        n, ids, known = asked.num_rows, np.asarray(asked.column("set_id")), {}
        lists = asked.column("terms").combine_chunks()
        flat = pc.list_flatten(lists)
        question = np.asarray(pc.list_parent_indices(lists)).astype(np.int64)
        coded = flat.field("term").dictionary_encode()
        number = np.array([known.setdefault(x, len(known)) for x in coded.dictionary.to_pylist()], np.int64)
        pattern, qtf = number[np.asarray(coded.indices).astype(np.int64)], np.asarray(flat.field("qtf")).astype(np.float64)
        of = {}
        for c, term, weight, avg in zip(*(weights.column(x).to_pylist() for x in ("collection", "term", "weight", "avg_tokens"))):
            if term in known:
                of.setdefault(c, ([], [], avg))
                of[c][0].append(known[term])
                of[c][1].append(weight)
        searches = {}
        # rows are many words long, so memory is bounded by their entries and not by their number
        for batch in _by_entries(batches, "terms", TERMS_AT_ONCE):
            lists = batch.column("terms")
            flat, parent = pc.list_flatten(lists), np.asarray(pc.list_parent_indices(lists)).astype(np.int64)
            words = flat.field("term")
            code = np.asarray(pc.index_in(words, value_set=pa.array(list(known), words.type)).fill_null(-1)).astype(np.int64)
            use = np.flatnonzero(code >= 0)
            row, code, tf = parent[use], code[use], np.asarray(flat.field("tf"))[use].astype(np.float64)
            names = batch.column("collection").dictionary_encode()
            name_of = np.asarray(names.indices.fill_null(-1)).astype(np.int64)
            chunk, size = np.asarray(batch.column("chunk_id")).astype(np.int64), np.asarray(batch.column("n_tokens")).astype(np.float64)
            for i, c in enumerate(names.dictionary.to_pylist()):
                if c not in of:
                    continue
                terms, weight, avg = of[c]
                weight_of = np.full(len(known), np.nan)
                weight_of[terms] = weight
                mine = np.flatnonzero(name_of == i)
                mine = mine[np.argsort(chunk[mine], kind="stable")]
                place = np.full(batch.num_rows, -1)
                place[mine] = np.arange(len(mine))
                use = np.flatnonzero((place[row] >= 0) & ~np.isnan(weight_of[code]))
                r, p, f = place[row[use]], code[use], tf[use]
                value = weight_of[p] * f * (k1 + 1) / (f + k1 * (1 - b + b * size[mine][r] / avg))
                order = np.lexsort((p, r))
                if c not in searches:
                    if (len(searches) + 1) * n * limit > KEPT:
                        searches.clear()  # costs rows that are given out, no more
                    searches[c] = _Search(question, pattern, qtf, n, len(known), limit, digits=6)
                q, at, score = searches[c].best(r[order], p[order], value[order], chunk[mine])
                if len(q):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[q]), pa.array([c] * len(q), kind), pa.array(chunk[mine][at]), pa.array(score)], names=["set_id", "collection", "chunk_id", "score"])

    return run


class _Asked:
    """Sets of terms as entries (question, pattern, qtf) in order of the question, and by collection the least sum of a block that each one reads."""

    def __init__(self, held, kind):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        asked, least, self.unnamed = held.value
        self.n, self.ids, self.kind, self.known = asked.num_rows, np.asarray(asked.column("set_id")).astype(np.int64), kind, {}
        lists = asked.column("terms").combine_chunks()
        flat = pc.list_flatten(lists)
        self.question = np.asarray(pc.list_parent_indices(lists)).astype(np.int64)
        coded = flat.field("term").dictionary_encode()
        number = np.array([self.known.setdefault(x, len(self.known)) for x in coded.dictionary.to_pylist()], np.int64)
        self.pattern, self.qtf = number[np.asarray(coded.indices).astype(np.int64)], np.asarray(flat.field("qtf")).astype(np.float64)
        self.start = np.searchsorted(self.question, np.arange(self.n))
        self.least = {}
        if least is not None:
            least = least.filter(pc.is_in(least.column("set_id"), pa.array(self.ids)))
            place = np.argsort(self.ids, kind="stable")
            at = place[np.searchsorted(self.ids[place], np.asarray(least.column("set_id")))]
            names = least.column("collection").combine_chunks().dictionary_encode()
            value, of = np.asarray(least.column("least")), np.asarray(names.indices).astype(np.int64)
            for i, c in enumerate(names.dictionary.to_pylist()):
                self.least[c] = np.full(self.n, self.unnamed)
                self.least[c][at[of == i]] = value[of == i]

    def reads(self, collection, total):
        """Which questions read a block of this collection by their sums over it."""
        return (total > 0) & (total >= self.least.get(collection, self.unnamed))

    def sums(self, code, most):
        """The most that a chunk of a block can have, for every question, from the largest value of each of its terms."""
        import numpy as np

        value = np.zeros(len(self.known))
        value[code] = np.maximum(most, 0)
        return np.add.reduceat(value[self.pattern] * self.qtf, self.start)

    def blocks(self, batches):
        """(collection, block, codes of the terms, rows) of every block; its rows follow each other, terms of other slices are left out."""
        import numpy as np
        import pyarrow as pa

        def cut(batch, last):
            names = batch.column("collection").dictionary_encode()
            name, block = np.asarray(names.indices).astype(np.int64), np.asarray(batch.column("block")).astype(np.int64)
            edges = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (block[1:] != block[:-1]))))
            ends = np.append(edges[1:], len(block))
            if not last:
                edges, ends = edges[:-1], ends[:-1]
            terms = batch.column("term").dictionary_encode()
            number = np.array([self.known.get(x, -1) for x in terms.dictionary.to_pylist()], np.int64)
            code, named = number[np.asarray(terms.indices).astype(np.int64)], names.dictionary.to_pylist()
            for a, b in zip(edges.tolist(), ends.tolist()):
                use = np.flatnonzero(code[a:b] >= 0)
                if len(use):
                    rows = batch.slice(a, b - a)
                    yield named[name[a]], int(block[a]), code[a:b][use], rows if len(use) == b - a else rows.take(pa.array(use))
            return int(ends[-1]) if len(ends) else 0

        held = None
        for batch in batches:
            if batch.num_rows:
                if held is not None:
                    batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                held = batch.slice((yield from cut(batch, False)))
        if held is not None:
            yield from cut(held, True)

    def given(self, kept, column):
        """Batches of what is kept per collection: (value, key) of each question, 0 for none."""
        import numpy as np
        import pyarrow as pa

        for c, (value, key) in kept.items():
            q, i = np.nonzero(value > 0)
            if len(q):
                columns = {"set_id": pa.array(self.ids[q]), "collection": pa.array([c] * len(q), self.kind), column: pa.array(key[q, i])}
                yield pa.RecordBatch.from_pydict(columns | {"bound" if column == "block" else "score": pa.array(value[q, i])})

    def room(self, kept, collection, most):
        """What is kept of a collection: values and keys of the best of each question."""
        import numpy as np

        if collection not in kept:
            kept[collection] = np.zeros((self.n, most)), np.full((self.n, most), (1 << 63) - 1, np.int64)
        return kept[collection]


def _first_of(value, key, most):
    """The highest values of every row and their keys, equal ones by the smaller key."""
    import numpy as np

    order = np.lexsort((key, -value), axis=1)[:, :most]
    return np.take_along_axis(value, order, 1), np.take_along_axis(key, order, 1)


def first_blocks(held, first, kind):
    """mapInArrow function over bounds (collection, block, term, bound), block by block: the blocks with the highest sums per set, collection and task."""

    def run(batches):
        import numpy as np

        asked, kept = _Asked(held, kind), {}
        for c, block, code, rows in asked.blocks(batches):
            if c not in kept and (len(kept) + 1) * asked.n * first > KEPT:
                yield from asked.given(kept, "block")  # costs rows that are given out, no more
                kept.clear()
            value, key = asked.room(kept, c, first)
            total = asked.sums(code, np.asarray(rows.column("bound")))
            q = np.flatnonzero((total > 0) & (total >= value[:, -1]))
            if len(q):
                value[q], key[q] = _first_of(np.column_stack((value[q], total[q])), np.column_stack((key[q], np.full(len(q), block))), first)
        yield from asked.given(kept, "block")

    return run


def wanted_blocks(held, kind):
    """mapInArrow function over bounds (collection, block, term, bound), block by block: the blocks that some set reads."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        asked = _Asked(held, kind)
        for c, block, code, rows in asked.blocks(batches):
            if asked.reads(c, asked.sums(code, np.asarray(rows.column("bound")))).any():
                yield pa.RecordBatch.from_pydict({"collection": pa.array([c], kind), "block": pa.array([block], pa.int64())})

    return run


def block_scores(held, limit, kind):
    """mapInArrow function over postings (collection, block, term, held <chunk_id, part>), block by block: the best chunks per set, collection and task.

    A set is scored on a block only if its sum over the block comes up to its least one.
    """

    def run(batches):
        import numpy as np
        import pyarrow.compute as pc

        asked, kept = _Asked(held, kind), {}
        for c, _, code, rows in asked.blocks(batches):
            lists = rows.column("held")
            flat, row = pc.list_flatten(lists), np.asarray(pc.list_parent_indices(lists)).astype(np.int64)
            part = np.asarray(flat.field("part")).astype(np.float64)
            total = asked.sums(code, np.maximum.reduceat(part, np.searchsorted(row, np.arange(len(code)))))
            if c not in kept and (len(kept) + 1) * asked.n * limit > KEPT:
                yield from asked.given(kept, "chunk_id")  # costs rows that are given out, no more
                kept.clear()
            value, key = asked.room(kept, c, limit)
            wanted = asked.reads(c, total)
            chunk, at = np.unique(np.asarray(flat.field("chunk_id")).astype(np.int64), return_inverse=True)
            table = np.zeros((len(chunk), len(code)))
            np.add.at(table, (at, row), part)
            local = np.full(len(asked.known), -1)
            local[code] = np.arange(len(code))
            entry = np.flatnonzero(wanted[asked.question] & (local[asked.pattern] >= 0))
            for low in range(0, len(entry), ENTRIES_AT_ONCE):
                # whole questions only: those that begin within the slice
                some = entry[slice(*np.searchsorted(asked.question[entry], (
                    asked.question[entry[low - 1]] + 1 if low else 0, asked.question[entry[min(low + ENTRIES_AT_ONCE, len(entry)) - 1]] + 1)))]
                if not len(some):
                    continue
                q, start = np.unique(asked.question[some], return_index=True)
                score = np.add.reduceat(table[:, local[asked.pattern[some]]] * asked.qtf[some], start, axis=1).T
                score = np.maximum(np.floor(score * 1e6 + 0.5) / 1e6, 0)
                good = (score >= np.maximum(value[q, -1:], 1e-6)).any(axis=1)
                q, score = q[good], score[good]
                if len(q):
                    value[q], key[q] = _first_of(np.hstack((value[q], score)), np.hstack((key[q], np.broadcast_to(chunk, score.shape))), limit)
        yield from asked.given(kept, "chunk_id")

    return run


def occurrences(held, text, out):
    """mapInArrow function: adds all places where one of the held (nth, name) occurs in a text column."""

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        for nth, name in held.value:
            automaton.add_word(name, (nth, len(name)))
        if len(automaton):
            automaton.make_automaton()
        kind = pa.list_(pa.struct([("nth", pa.int64()), ("at", pa.int32()), ("size", pa.int32())]))
        for batch in batches:
            rows = []
            for t in batch.column(text).to_pylist():
                found = automaton.iter(t) if t and len(automaton) else ()
                rows.append([{"nth": nth, "at": end + 1 - size, "size": size} for end, (nth, size) in found])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, out])

    return run


def longest_first(found, out):
    """mapInArrow function: of overlapping occurrences those of the smallest nth stay, from the left."""

    def run(batches):
        from bisect import bisect_right

        import pyarrow as pa

        for batch in batches:
            rows = []
            for row in batch.column(found).to_pylist():
                starts, ends, kept = [], [], []
                for x in sorted(row or (), key=lambda x: (x["nth"], x["at"])):
                    a, b = x["at"], x["at"] + x["size"]
                    i = bisect_right(starts, a)
                    if (i == 0 or ends[i - 1] <= a) and (i == len(starts) or starts[i] >= b):
                        starts.insert(i, a)
                        ends.insert(i, b)
                        kept.append(x)
                rows.append(sorted(kept, key=lambda x: x["at"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, batch.column(found).type)], names=[*batch.schema.names, out])

    return run


def common_subsequence(x, y):
    """Length of the longest common subsequence of two lists of numbers.

    A row of the table is one large integer, a bit per token of ``x`` that is
    zero where the row grows by one; a token of ``y`` turns the whole row into the
    next one with an addition and a subtraction over machine words.
    """
    places = {}
    for i, token in enumerate(x):
        places[token] = places.get(token, 0) | 1 << i
    whole = (1 << len(x)) - 1
    row = whole
    for token in y:
        met = row & places.get(token, 0)
        row = ((row + met) | (row - met)) & whole
    return len(x) - row.bit_count()


def token_overlap(left, right):
    """Per row of two token lists: longest common subsequence and clipped token matches."""
    import numpy as np
    import pandas as pd

    lcs, clipped = [], []
    for a, b in zip(left, right):
        if a is None or b is None or len(a) == 0 or len(b) == 0:
            lcs.append(0)
            clipped.append(0)
            continue
        codes = {}
        x = np.array([codes.setdefault(t, len(codes)) for t in a])
        y = np.array([codes.setdefault(t, len(codes)) for t in b])
        size = len(codes)
        clipped.append(int(np.minimum(np.bincount(x, minlength=size), np.bincount(y, minlength=size)).sum()))
        lcs.append(common_subsequence(x.tolist(), y.tolist()))
    return pd.DataFrame({"lcs": np.array(lcs, np.int32), "clipped": np.array(clipped, np.int32)})


def split_texts(texts, size, overlap, separators):
    """Chunks of every text in a pandas series."""
    import pandas as pd

    return pd.Series([split_text(t or "", size, overlap, separators) for t in texts])


def split_text(text, size, overlap, separators):
    """Chunks of one text: cut at the coarsest separator present, finer ones only inside long pieces.

    An explicit stack of (piece, ladder level) keeps the order; finished pieces
    collect in ``run`` and are packed whenever an over-long piece interrupts them.
    """
    done = []

    def pack(run, glue):
        window, used = [], 0
        step = len(glue)
        for piece in run:
            if window and used + len(piece) + step > size:
                joined = glue.join(window).strip()
                if joined:
                    done.append(joined)
                while window and (used > overlap or used + len(piece) + step > size):
                    used -= len(window[0]) + (step if len(window) > 1 else 0)
                    window.pop(0)
            used += len(piece) + (step if window else 0)
            window.append(piece)
        joined = glue.join(window).strip()
        if joined:
            done.append(joined)

    def descend(part, level):
        while level < len(separators) - 1 and separators[level] and separators[level] not in part:
            level += 1
        sep = separators[level]
        if sep == "":
            pieces = list(part)
        else:
            head, *rest = part.split(sep)
            pieces = [p for p in [head, *(sep + r for r in rest)] if p]
        run = []
        for piece in pieces:
            if len(piece) < size:
                run.append(piece)
                continue
            if run:
                pack(run, "")
                run = []
            if level + 1 >= len(separators):
                done.append(piece)
            else:
                descend(piece, level + 1)
        if run:
            pack(run, "")

    descend(text, 0)
    return done


cloudpickle.register_pickle_by_value(sys.modules[__name__])
