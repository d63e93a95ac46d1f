"""Near-duplicate embeddings by an inverted multi-index.

Vectors are compared by their directions. Each half of the dimensions has a codebook of its own; the product of the two
codebooks is a grid of cells, each vector at home in the cell of its nearest centroids. A vector's query visits the
cells in the order of the multi-sequence traversal: the two codebooks' centroids sorted by distance, pairs of them by
the sum. The traversal ends at the sum under which copies at the threshold lie with the target recall (calibrated on
perturbed vectors, see ``fit``); what it visits up to a sum is the staircase under that sum, taken row by row. Two
vectors meet if one of them visits the other's cell, and every pair that meets is verified in double precision.

Groups of copies too large for a cell are taken out first: ``pivots`` are the centres of the tight groups that a
sample shows, and a vector within half the threshold's angle of its nearest pivot belongs to that pivot's ball. All
members of a ball link with each other, by the triangle inequality, so they are counted and not compared. A vector
outside of a ball can link with a member only if it is within one and a half times the angle of the pivot; these few
meet the ball's members, which are dealt over tasks of bounded size. This part is exact.

The grid's cells are dealt to tasks by blocks of neighbouring cells (regions), as many as keep a region's rows bounded;
a vector is sent once to each region that it visits, with the cells that it visits there (at home with all of them), and
equal vectors are merged before they are sent. A region's task holds the vectors at home in it; visitors pass by in chunks.
It returns counts and, for the components, one edge a vector, not pairs.

Defined results: a vector that is null, empty, zero, holds null or non-finite components, or has another length than
most (of equally frequent lengths the larger counts) links with nothing; equal vectors link, also where rows share an
id; a component's id is its smallest vec_id that is not null; a vector that links with nothing is its own component,
and a row without an id is kept exactly if its component has none; other columns are ignored, whatever their names; an
empty table gives no rows. Equal vectors are told by a 128-bit hash of their components.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import acos, ceil, cos

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm import kernel as K
from ragspark.llm.jaccard import components
from ragspark.llm.shared import save, small_batches

THRESHOLD = 0.95
#: Rows of the sample, at most (in expectation), and its components; vectors a cell; rows a region; members of a ball
#: in a task.
SAMPLE, COMPONENTS, CELL, REGION, SPLIT = 16384, 1 << 23, 16, 1 << 16, 1 << 16
#: Rows that are turned into rows for the tasks at once; visitors that a task compares at once.
SEND, CHUNK = 1000, 1 << 15
#: Share of perturbed copies, at the threshold exactly, that must meet; the stop is that much farther still, since real
#: copies are not turned at random.
TARGET, MARGIN = 0.9995, 1.25
#: A ball needs this share of the sample, and this many rows of it.
HEAVY, LEAST = 1 / 512, 16
BLOCK = 1024


def read(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The valid vectors of an array column (rows of 32- or 64-bit floats) and their places in it."""
    column = column.cast(pa.large_list(column.type.value_type)) if not pa.types.is_large_list(column.type) else column
    kind = np.float32 if column.type.value_type == pa.float32() else np.float64
    off = column.offsets.to_numpy()
    size = np.diff(off)
    right = np.flatnonzero((size == dims) & ~np.asarray(column.is_null()))
    values = column.values
    held = np.asarray(values.fill_null(np.nan)) if values.null_count else np.asarray(values)
    rows = held.astype(kind, copy=False)[off[right][:, None] + np.arange(dims)[None, :]] if dims and len(right) else np.zeros((0, dims), kind)
    able = np.isfinite(rows).all(1) & (rows != 0).any(1)
    return rows[able], right[able]


def unit(rows: np.ndarray) -> np.ndarray:
    """Directions, in double precision."""
    wide = rows.astype(np.float64)
    wide /= np.abs(wide).max(1, keepdims=True)  # squares neither vanish nor overflow
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def keys(rows: np.ndarray) -> list[bytes]:
    body = (rows + 0.0).astype(rows.dtype)  # one zero
    size = body.dtype.itemsize * body.shape[1]
    flat = body.tobytes()
    return [hashlib.blake2b(flat[i : i + size], digest_size=16).digest() for i in range(0, len(flat), size)] if size else []


def lloyd(rows: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    """k centroids by Lloyd's iteration."""
    centres = rows[rng.permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        near = np.concatenate([distances(rows[i : i + 4096], centres).argmin(1) for i in range(0, len(rows), 4096)])
        order = np.argsort(near, kind="stable")
        held, begin = np.unique(near[order], return_index=True)
        centres[held] = np.add.reduceat(rows[order], begin) / np.diff(np.append(begin, len(rows)))[:, None]
    return centres


def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each centre, less the row's own square."""
    return (centres * centres).sum(1)[None, :] - 2 * (rows @ centres.T)


@dataclass
class Index:
    """What the tasks know: bounded by the sample, whatever the table."""

    dims: int
    books: list[np.ndarray]  # a codebook for each half
    blocks: list[np.ndarray]  # for each half, the block of cells that a centroid belongs to
    stop: float  # the traversal's last sum of distances, less that of the home cell
    pivots: np.ndarray
    threshold: float

    def excess(self, rows: np.ndarray) -> list[np.ndarray]:
        """For each half the distances to its centroids, less the nearest one's."""
        half = self.dims // 2
        out = [distances(part, book) for part, book in zip((rows[:, :half], rows[:, half:]), self.books, strict=True)]
        return [d - d.min(1, keepdims=True) for d in out]

    def visits(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home cell of each row, row of each visit, cell of each visit); the home cell is visited too."""
        first, second = self.excess(rows)
        width = len(self.books[1])
        home = first.argmin(1) * width + second.argmin(1)
        # The two sorted sequences; for each step of the first, as many steps of the second as the sum allows.
        order = np.argsort(second, axis=1, kind="stable")
        ranked = np.take_along_axis(second, order, 1)
        row, one = np.nonzero(first <= self.stop)
        left = self.stop - first[row, one]
        many, step = np.zeros(len(row), np.int64), max(1, (1 << 21) // width)
        for i in range(0, len(row), step):
            many[i : i + step] = (ranked[row[i : i + step]] <= left[i : i + step, None]).sum(1)
        which, step = K.many(many)
        return home, row[which], one[which] * width + order[row[which], step]

    def region(self, cell: np.ndarray) -> np.ndarray:
        width = len(self.books[1])
        return self.blocks[0][cell // width] * (self.blocks[1].max() + 1) + self.blocks[1][cell % width]

    def balls(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ball of each row or -1; row and ball of each pair in which the row can link with members of the ball)."""
        if not len(self.pivots):
            return np.full(len(rows), -1), np.zeros(0, np.int64), np.zeros(0, np.int64)
        angle = np.arccos(np.clip(rows @ self.pivots.T, -1, 1))
        reach, slack = acos(self.threshold), 1e-6
        own = np.where(angle.min(1) <= reach / 2 - slack, angle.argmin(1), -1)
        row, ball = np.nonzero(angle <= 1.5 * reach + slack)
        able = (own[row] != ball) & ((own[row] < 0) | (own[row] > ball))  # members of two balls meet in the first one's
        return own, row[able], ball[able]


def tight(sample: np.ndarray, cell: np.ndarray, threshold: float, rng) -> np.ndarray:
    """Centres of the groups of the sample that fit in a ball and are too large for a cell."""
    found, least = [], max(LEAST, int(HEAVY * len(sample)))
    radius = cos(acos(threshold) / 2)
    held, count = np.unique(cell, return_counts=True)
    for c in held[count >= least]:
        rows = sample[cell == c]
        while len(rows) >= least:
            seen = rows[rng.permutation(len(rows))[:512]]
            centre = seen[(seen @ seen.T >= threshold).sum(1).argmax()]
            for _ in range(3):
                near = rows[rows @ centre >= radius]
                if len(near):
                    centre = near.mean(0)
                    centre /= np.linalg.norm(centre)
            inside = rows @ centre >= radius
            if inside.sum() < least:
                break
            found.append(centre)
            rows = rows[~inside]
    # A group that lies in several cells is found in each: the largest centre covers it, the others go.
    chosen, free = [], np.ones(len(sample), bool)
    inside = [sample @ c >= radius for c in found]
    for i in sorted(range(len(found)), key=lambda i: -int(inside[i].sum())):
        if (inside[i] & free).sum() >= least:
            chosen.append(found[i])
            free &= ~inside[i]
    return np.array(chosen) if chosen else np.zeros((0, sample.shape[1]))


def fit(sample: np.ndarray, n: int, threshold: float = THRESHOLD, target: float = TARGET) -> Index:
    """An index for ``n`` vectors, fitted on the directions of a sample of them.

    The stop is found on copies of sampled vectors, turned by the threshold's angle in random directions: the farthest
    ones that have to be found. Either of the two may visit the other's cell."""
    rng = np.random.default_rng(7)
    dims = sample.shape[1]
    half = dims // 2
    k = int(min(len(sample), 4096, 2 ** max(0, round(np.log2(max(1.0, (n / CELL) ** 0.5))))))
    index = Index(dims, [lloyd(part, k, rng) for part in (sample[:, :half], sample[:, half:])], [], 0.0, np.zeros((0, dims)), threshold)
    # Blocks: about four centroids of the first half, and of the second as many as keep a region's rows bounded.
    for book, most in zip(index.books, (ceil(k / 4) if n <= REGION * k / 4 else k, max(1, min(k, ceil(n / REGION / k)))), strict=True):
        centres = lloyd(book, most, rng, 4)
        index.blocks.append(distances(book, centres).argmin(1).astype(np.int64))
    ask = sample[rng.permutation(len(sample))[:4000]]
    turn = rng.normal(size=ask.shape)
    turn -= (turn * ask).sum(1, keepdims=True) * ask
    length = np.linalg.norm(turn, axis=1, keepdims=True)
    turn = np.divide(turn, length, out=np.zeros_like(turn), where=length > 0)
    copy = threshold * ask + (1 - threshold**2) ** 0.5 * turn
    a, b = index.excess(ask), index.excess(copy)
    rows = np.arange(len(ask))
    there = sum(x[rows, y.argmin(1)] for x, y in zip(a, b, strict=True))
    back = sum(y[rows, x.argmin(1)] for x, y in zip(a, b, strict=True))
    index.stop = MARGIN * float(np.quantile(np.minimum(there, back), target)) + 1e-9
    index.pivots = tight(sample, sum(x.argmin(1) * w for x, w in zip(index.excess(sample), (k, 1), strict=True)), threshold, rng)
    return index


def dimension(vectors: DataFrame, column: str) -> int:
    """The most frequent length that is not 0, the larger one of equally frequent lengths."""
    count = vectors.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("size")).count().where("size > 0")
    top = count.orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return top[0]["size"] if top else 0


def sampled(vectors: DataFrame, dims: int, n: int, most: int = SAMPLE) -> np.ndarray:
    """Directions of about ``most`` rows (fewer of long vectors, so that 64 MB hold them), chosen by a hash of the row's id and components, so always the same ones."""
    most = max(1, min(most, COMPONENTS // max(1, dims)))
    spot = F.pmod(F.xxhash64("vec_id", "vec"), F.lit(1 << 30))
    chosen = vectors.where(F.size("vec") == dims).where(spot < F.lit(int((1 << 30) * min(1.0, most / max(1, n)))) if n > most else F.lit(True))
    body = chosen.select("vec").toArrow().column("vec").combine_chunks()
    rows = read(body.combine_chunks() if isinstance(body, pa.ChunkedArray) else body, dims)[0]
    out = unit(rows) if len(rows) else np.zeros((0, dims))
    return out[np.lexsort(out.T[::-1])] if len(out) else out  # the order of arrival plays no part


MEMBER = "vec_id long, key binary, ball int"


def _members(index: Index):
    """(vec_id, key, ball) of every row; no key where the vector links with nothing."""

    def run(batches):
        for batch in batches:
            rows, place = read(batch.column(1), index.dims)
            ball = np.full(batch.num_rows, -1, np.int32)
            key: list = [None] * batch.num_rows
            if len(rows):
                ball[place] = index.balls(unit(rows))[0]
                for i, x in zip(place.tolist(), keys(rows), strict=True):
                    key[i] = x
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key, pa.binary()), pa.array(ball)], names=["vec_id", "key", "ball"])

    return run


SENT = "task long, role int, key binary, copies long, home long, cells binary, vec binary"
HOME, VISITOR, INSIDE, OUTSIDE = range(4)


def _send(index: Index, splits: np.ndarray):
    """Rows for the tasks: regions from 0 on, parts of balls below 0."""
    first = np.concatenate(([0], np.cumsum(splits)))

    def run(batches):
        for batch in (whole.slice(i, SEND) for whole in batches for i in range(0, whole.num_rows, SEND)):
            rows, _ = read(batch.column(1), index.dims)
            if not len(rows):
                continue
            names = np.array(keys(rows), "V16")
            names, at, copies = np.unique(names, return_index=True, return_counts=True)
            rows = rows[at]
            turned = unit(rows)
            body = [r.tobytes() for r in rows]
            task, role, who, home, cells = [], [], [], [], []

            def add(tasks, kind, owners, homes=None, visited=None):
                task.append(tasks)
                role.append(np.full(len(tasks), kind, np.int32))
                who.append(owners)
                home.append(np.full(len(tasks), -1, np.int64) if homes is None else homes)
                cells.extend([b""] * len(tasks) if visited is None else visited)

            ball, near, of = index.balls(turned)
            light = np.flatnonzero(ball < 0)
            if len(light):
                own, row, cell = index.visits(turned[light])
                region = index.region(cell)
                order = np.lexsort((region, row))
                row, region, body_of = row[order], region[order], cell[order].astype("<i4").tobytes()
                begin = np.searchsorted(row, np.arange(len(light) + 1))
                add(index.region(own), HOME, light, own, [body_of[4 * i : 4 * j] for i, j in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)])
                begin = np.append(np.flatnonzero(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(region) != 0)))), len(row))
                away = np.flatnonzero(region[begin[:-1]] != index.region(own)[row[begin[:-1]]])
                who_visits = row[begin[away]]
                add(region[begin[away]], VISITOR, light[who_visits], own[who_visits], [body_of[4 * i : 4 * j] for i, j in zip(begin[away].tolist(), begin[away + 1].tolist(), strict=True)])
            inside = np.flatnonzero(ball >= 0)
            if len(inside):
                spot = np.frombuffer(names[inside].tobytes(), "<u4").reshape(-1, 4)[:, 0] % splits[ball[inside]]
                add(-1 - (first[ball[inside]] + spot), INSIDE, inside)
            if len(near):
                which, step = K.many(splits[of])
                add(-1 - (first[of[which]] + step), OUTSIDE, near[which])
            who = np.concatenate(who)
            flat = names.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(task).astype(np.int64)),
                    pa.array(np.concatenate(role)),
                    pa.array([bytes(flat[i]) for i in who.tolist()], pa.binary()),
                    pa.array(copies[who].astype(np.int64)),
                    pa.array(np.concatenate(home)),
                    pa.array(cells, pa.binary()),
                    pa.array([body[i] for i in who.tolist()], pa.binary()),
                ],
                names=["task", "role", "key", "copies", "home", "cells", "vec"],
            )
        K.release()

    return run


def close(a: np.ndarray, b: np.ndarray, threshold: float):
    """Blocks (i, j) of the rows of ``a`` and ``b`` whose cosine is at or above the threshold, in double precision. Single precision
    decides what is far from the threshold."""
    small_a, small_b = a.astype(np.float32), b.astype(np.float32)
    for i in range(0, len(a), BLOCK):
        for j in range(0, len(b), BLOCK):
            x, y = np.nonzero(small_a[i : i + BLOCK] @ small_b[j : j + BLOCK].T >= threshold - 1e-4)
            x += i
            y += j
            for k in range(0, len(x), 1 << 18):
                p, q = x[k : k + (1 << 18)], y[k : k + (1 << 18)]
                ok = np.einsum("ij,ij->i", a[p], b[q]) >= threshold
                if ok.any():
                    yield p[ok], q[ok]


class Groups:
    """Components within a task, so that it returns one edge a vector."""

    def __init__(self, n: int):
        self.low = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.low[a], self.low[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.low, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.low[self.low]
                if (up == self.low).all():
                    break
                self.low = up


def _found(index: Index, kind: str):
    """(key, links, other): the links that a task adds to a vector, and a vector of its component."""

    def distinct(held: list[pa.RecordBatch]):
        """The equal vectors of some rows as one: keys, directions, copies, home cells, and visits (cell, row)."""
        t = pa.Table.from_batches(held)
        key = np.frombuffer(b"".join(t.column("key").to_pylist()), "V16")
        unique, at, back = np.unique(key, return_index=True, return_inverse=True)
        copies = np.bincount(back, weights=t.column("copies").to_numpy()).astype(np.int64)
        take = pa.array(at)
        vec = unit(np.frombuffer(b"".join(t.column("vec").take(take).to_pylist()), kind).reshape(len(at), index.dims))
        listed = t.column("cells").take(take).to_pylist()
        visitor = np.repeat(np.arange(len(at)), [len(c) // 4 for c in listed])
        return unique, vec, copies, t.column("home").to_numpy()[at], np.frombuffer(b"".join(listed), "<i4").astype(np.int64), visitor

    class Task:
        """A region or a part of a ball: the vectors at home in it, with what has been found for them."""

        def __init__(self, task: int, held: list[pa.RecordBatch]):
            self.task = task
            self.key, self.vec, self.copies, home, cell, visitor = distinct(held)
            self.count, self.names = np.zeros(len(self.key), np.int64), Groups(len(self.key))
            if task >= 0:
                self.visits = np.sort(cell * len(self.key) + visitor)
                self.own = np.argsort(home, kind="stable")
                self.held, begin = np.unique(home[self.own], return_index=True)
                self.begin = np.append(begin, len(self.own))
                for p, q in self.met(self.vec, cell, visitor):
                    self.linked(p[p != q], q[p != q], self.copies, home, self.count, 0)

        def met(self, vec: np.ndarray, cell: np.ndarray, visitor: np.ndarray):
            """Blocks of pairs of a visitor and a vector at home that are close."""
            if self.task < 0:
                yield from ((p, q) for q, p in close(self.vec, vec, index.threshold))
                return
            here = index.region(cell) == self.task
            order = np.argsort(cell[here], kind="stable")
            cell, visitor = cell[here][order], visitor[here][order]
            first, last = np.searchsorted(cell, self.held), np.searchsorted(cell, self.held, "right")
            for c in np.flatnonzero(last > first).tolist():
                x, y = visitor[first[c] : last[c]], self.own[self.begin[c] : self.begin[c + 1]]
                yield from ((x[p], y[q]) for p, q in close(vec[x], self.vec[y], index.threshold))

        def linked(self, p: np.ndarray, q: np.ndarray, copies: np.ndarray, home: np.ndarray, count: np.ndarray, offset: int) -> None:
            """Counts visitors' links (p) with those at home (q); ``offset`` is where visitors stand in the groups."""
            np.add.at(count, p, self.copies[q])
            if self.task < 0:
                np.add.at(self.count, q, copies[p])
            else:
                # Does q visit p's cell? If not, it never meets p elsewhere.
                code = home[p] * len(self.key) + q
                spot = np.searchsorted(self.visits, code)
                met = (spot < len(self.visits)) & (self.visits[np.minimum(spot, len(self.visits) - 1)] == code)
                np.add.at(self.count, q[~met], copies[p[~met]])
            self.names.add(p + offset, q)

        def visited(self, held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
            """Visitors pass by: what is found for them. Their group is that of a vector at home, whose own row leads on."""
            key, vec, copies, home, cell, visitor = distinct(held)
            count, here = np.zeros(len(key), np.int64), len(self.key)
            self.names.low = np.append(self.names.low, np.arange(here, here + len(key)))
            for p, q in self.met(vec, cell, visitor):
                self.linked(p, q, copies, home, count, here)
            low, self.names.low = self.names.low[here:], self.names.low[:here]
            return self.told(key, count, low, np.flatnonzero(low < here))

        def ended(self) -> pa.RecordBatch | None:
            low = self.names.low
            return self.told(self.key, self.count, low, np.flatnonzero((self.count > 0) | (low != np.arange(len(low)))))

        def told(self, key: np.ndarray, count: np.ndarray, low: np.ndarray, out: np.ndarray) -> pa.RecordBatch | None:
            if not len(out):
                return None
            names = lambda x: pa.array([bytes(k) for k in x.tolist()], pa.binary())
            return pa.RecordBatch.from_arrays([names(key[out]), pa.array(count[out]), names(self.key[low[out]])], names=["key", "links", "other"])

    def run(batches):
        # Rows come by task, those at home first, then by key.
        now, homes, task, passing, waiting = None, [], None, [], 0

        def done():
            if task is not None:
                if passing:
                    yield task.visited(passing)
                yield task.ended()
            elif homes:
                yield Task(now, homes).ended()

        for batch in batches:
            tasks, away = batch.column(0).to_numpy(), np.isin(batch.column(1).to_numpy(), (VISITOR, OUTSIDE))
            cut = np.concatenate(([0], np.flatnonzero((np.diff(tasks) != 0) | (np.diff(away) != 0)) + 1, [len(tasks)]))
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if i == j:
                    continue
                if tasks[i] != now:
                    yield from (x for x in done() if x is not None)
                    now, homes, task, passing, waiting = int(tasks[i]), [], None, [], 0
                rows = batch.slice(i, j - i)
                if not away[i]:
                    homes.append(rows)
                    continue
                if not homes and task is None:
                    continue  # nobody is at home
                if task is None:
                    task, homes = Task(now, homes), []
                # A key's rows stay together: a chunk ends before the first row of the last key.
                if waiting >= CHUNK:
                    key = rows.column(2).to_pylist()
                    last = passing[-1].column(2)[-1].as_py()
                    same = next((n for n, x in enumerate(key) if x != last), len(key))
                    passing.append(rows.slice(0, same))
                    if same < len(key):
                        if (out := task.visited(passing)) is not None:
                            yield out
                        passing, waiting, rows = [], 0, rows.slice(same)
                    else:
                        continue
                passing.append(rows)
                waiting += len(rows)
        yield from (x for x in done() if x is not None)
        K.release()

    return run


def near_copies(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """A row per vector: key, n_links, component_id, kept (the one of its component with the smallest id)."""
    if not 0 < threshold < 1:
        raise ValueError("threshold must be between 0 and 1")
    spark = vectors.sparkSession
    small_batches(spark, 10_000)
    own = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("vec"))
    if dict(own.dtypes)["vec"] not in ("array<float>", "array<double>"):
        own = own.withColumn("vec", F.col("vec").cast("array<double>"))
    kind = "<f4" if dict(own.dtypes)["vec"] == "array<float>" else "<f8"
    dims, n = dimension(own, "vec"), own.count()
    sample = sampled(own, dims, n)
    alone = own.select(F.col("vec_id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not len(sample):
        return alone
    index = fit(sample, n, threshold, target)
    members = save(own.mapInArrow(_members(index), MEMBER), "members")

    # Balls are at most as many as the sample allows (1 / HEAVY), so their sizes may be told to all tasks.
    sizes = members.where("ball >= 0").groupBy("ball").agg(F.count("*").alias("all"))
    size = np.zeros(max(1, len(index.pivots)), np.int64)
    for row in sizes.collect():
        size[row["ball"]] = row["all"]
    splits = np.maximum(1, -(-size // SPLIT))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = own.mapInArrow(_send(index, splits), SENT).repartition(parts, "task").sortWithinPartitions("task", "role", "key")
    found = save(sent.mapInArrow(_found(index, kind), "key binary, links long, other binary"), "found")

    # Components over nodes: a ball is one node, other vectors are nodes of their own.
    named = members.select("key", "ball").where("ball >= 0").join(found.selectExpr("key").union(found.selectExpr("other AS key")).distinct(), "key", "left_semi").distinct()
    named = save(named.select("key", F.concat(F.lit("ball "), F.col("ball").cast("string")).cast("binary").alias("node")), "nodes")
    a = found.where("key <> other").join(named, "key", "left").select(F.coalesce("node", "key").alias("a"), "other")
    edges = a.join(named.withColumnsRenamed({"key": "other"}), "other", "left").select("a", F.coalesce("node", "other").alias("b")).distinct()
    comp = components(edges)

    node = F.when(F.col("ball") >= 0, F.concat(F.lit("ball "), F.col("ball").cast("string")).cast("binary")).otherwise(F.col("key"))
    valid = members.where("key IS NOT NULL").withColumn("cls", node)
    low = save(valid.groupBy("cls").agg(F.min("vec_id").alias("low"), F.count("*").alias("same")).join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "lowest")
    least = low.groupBy("comp").agg(F.min("low").alias("least"))
    # What most vectors have needs no row: a node alone, of one vector, without links.
    groups = low.join(comp.select("comp").distinct(), "comp", "left_semi").join(least, "comp").select("cls", "least", "same")
    groups = groups.unionByName(low.where("same > 1").join(comp.select("cls"), "cls", "left_anti").select("cls", F.col("low").alias("least"), "same"))
    groups = save(groups, "groups")
    links = found.groupBy("key").agg(F.sum("links").alias("links")).where("links > 0")
    out = members.withColumn("cls", node).join(groups, "cls", "left").join(links, "key", "left")
    total = F.coalesce("links", F.lit(0)) + F.coalesce(F.col("same") - 1, F.lit(0))
    component = F.when(F.col("same").isNotNull(), F.col("least")).otherwise(F.col("vec_id"))
    return out.select(F.col("vec_id").alias(key), total.cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
