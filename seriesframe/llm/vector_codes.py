"""Short codes for vectors: exact integer k-means per part of the vectors, over trees of balls built from anchors."""

from __future__ import annotations

import hashlib
import math
import pickle
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from seriesframe.llm.sharing import received, sent
from seriesframe.sources.files import settle

#: Components of a chunk of vectors, whose trees are built and searched together, and most points of an undivided ball.
CHUNK_VALUES, LEAF = 1 << 19, 64
#: Bits of a sum that travel in one row.
LIMB = 60
LARGEST = 2**63 - 1


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) exactly: int64 where that is safe, Python integers for larger components."""
    if not x.size or np.abs(x).max() < 2**30:
        return np.floor(x * scale).astype(np.int64)
    return np.array([[math.floor(v * scale) if abs(v) < 2**40 else int(v) * scale for v in row] for row in x.tolist()], object)


def edges(d: int, parts: int) -> list[int]:
    """Where the parts of a vector of ``d`` components begin and end; the first ones are longer if ``d`` is no multiple."""
    return [k * (d // parts) + min(k, d % parts) for k in range(parts + 1)]


def _floats(x: np.ndarray) -> np.ndarray:
    """Coordinates for bounds; what no double can hold is infinite, so nothing is concluded from it."""
    try:
        return x.astype(np.float64)
    except OverflowError:
        return np.array([[v if abs(v) < 2**1000 else math.inf for v in row] for row in x.tolist()], np.float64)


def _length(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("...k,...k->...", x, x))


def anchors(x: np.ndarray, most: int) -> np.ndarray:
    """The anchor that owns each point: each new anchor is the point farthest from its own one, and takes the points that are
    nearer to it. Points within half the distance of two anchors cannot change hands, so they are not looked at."""
    owner, pivots = np.zeros(len(x), np.int64), [0]
    distance = _length(x - x[0])
    for new in range(1, most):
        far = int(distance.argmax())
        if not distance[far] > 0:
            break
        between = _length(x[pivots] - x[far])
        near = np.flatnonzero(2 * distance > between[owner])
        to_new = _length(x[near] - x[far])
        won = to_new < distance[near]
        owner[near[won]], distance[near[won]] = new, to_new[won]
        pivots.append(far)
    return owner


def _joined(balls: list[tuple]) -> tuple:
    """One tree of several balls (tree, points, centre, radius): the two whose common ball is least are joined first."""
    trees = [b[0] for b in balls]
    size = np.array([b[1] for b in balls], np.float64)
    centre = np.array([b[2] for b in balls])
    radius = np.array([b[3] for b in balls])

    def cost(i: int) -> np.ndarray:
        two = (_length(centre - centre[i]) + radius + radius[i]) / 2
        return np.nan_to_num(np.maximum(two, np.maximum(radius, radius[i])), nan=1e300, posinf=1e300)

    costs = np.array([cost(i) for i in range(len(balls))])
    np.fill_diagonal(costs, np.inf)
    for _ in range(len(balls) - 1):
        i, j = sorted(divmod(int(costs.argmin()), len(balls)))
        middle = (centre[i] * size[i] + centre[j] * size[j]) / (size[i] + size[j])
        radius[i] = max(_length(middle - centre[i]) + radius[i], _length(middle - centre[j]) + radius[j])
        trees[i], size[i], centre[i] = (trees[i], trees[j]), size[i] + size[j], middle
        costs[j], costs[:, j] = np.inf, np.inf
        gone = np.isinf(costs[i])
        gone[i] = True
        costs[i] = np.where(gone, np.inf, cost(i))
        costs[:, i] = costs[i]
    return trees[i], size[i], centre[i], radius[i]


def _ball(x: np.ndarray, rows: np.ndarray) -> tuple:
    """Tree, number of points, centre and radius; a tree is an array of rows or a pair of trees.

    Middle out: about sqrt(n) anchors in the middle, joined upwards in pairs, divided downwards in the same way.
    """
    own = x[rows]
    if len(rows) > LEAF:
        owner = anchors(own, max(2, math.isqrt(len(rows))))
        groups = [rows[owner == k] for k in range(int(owner.max()) + 1)]
        groups = [g for g in groups if len(g)]
        if len(groups) > 1:
            return _joined([_ball(x, g) for g in groups])
    centre = own.mean(axis=0)
    return rows, len(rows), centre, float(_length(own - centre).max(initial=0.0))


@dataclass
class Tree:
    """Points in the order of the balls, so each ball is a stretch; and per ball its stretch, children, sum, centre, radius."""

    points: np.ndarray
    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    right: np.ndarray
    sums: np.ndarray
    centre: np.ndarray
    radius: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray) -> Tree:
        x = _floats(points)
        order, low, high, left, right = [], [], [], [], []
        done = 0
        todo = [(_ball(x, np.arange(len(x)))[0], -1, left)]
        while todo:  # parents before children, left before right
            tree, parent, side = todo.pop()
            number = len(low)
            if parent >= 0:
                side[parent] = number
            low.append(done)
            high.append(done)
            left.append(-1)
            right.append(-1)
            if isinstance(tree, tuple):
                todo += [(tree[1], number, right), (tree[0], number, left)]
            else:
                order.append(tree)
                done += len(tree)
                high[number] = done
        for number in range(len(low) - 1, -1, -1):
            if left[number] >= 0:
                high[number] = high[right[number]]
        order = np.concatenate(order)
        points, low, high = points[order], np.array(low), np.array(high)
        before = np.concatenate([np.zeros((1, points.shape[1]), points.dtype), points.cumsum(axis=0)])
        sums = before[high] - before[low]
        centre = _floats(sums) / (high - low)[:, None]
        x, radius = x[order], np.zeros(len(low))
        for some in np.array_split(np.arange(len(low)), -(-int((high - low).sum()) // (1 << 17))):
            if len(some):
                rows, ball = _stretches(low[some], high[some])
                off = _length(x[rows] - centre[some][ball])
                radius[some] = np.maximum.reduceat(off, np.searchsorted(ball, np.arange(len(some))))
        narrow = points.dtype != object and _top(points) < 2**31
        return cls(points.astype(np.int32) if narrow else points, order, low, high, np.array(left), np.array(right), sums, centre, radius)

    def owners(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Balls owned as a whole and their entries, and the other points and theirs.

        Balls are gone through level by level. A ball inherits the entries that can be nearest to any of its points and drops
        those that lie farther from all of them than some other entry does; a ball with one entry left is owned. What is
        left of undivided balls is compared point by point in integers, ties to the lower entry.
        """
        far = _floats(entries)
        scale = max(float(np.abs(far).max(initial=0.0)), float(np.abs(self.centre).max(initial=0.0)))
        balls, owner_of, points, nearest = [], [], [], []
        at, open_to = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
        while len(at):
            distance = _length(self.centre[at][:, None, :] - far[None])
            reach = self.radius[at][:, None]
            least = np.where(open_to, distance + reach, np.inf).min(axis=1)[:, None]
            # The margin is far wider than the rounding of the doubles; not-a-number keeps an entry.
            open_to = open_to & ~(distance - reach > least + 1e-9 * (least + scale))
            owned = open_to.sum(axis=1) == 1
            balls.append(at[owned])
            owner_of.append(open_to[owned].argmax(axis=1))
            leaf = ~owned & (self.left[at] < 0)
            if leaf.any():
                rows, ball = _stretches(self.low[at[leaf]], self.high[at[leaf]])
                points.append(rows)
                nearest.append(self._nearest(rows, entries, open_to[leaf][ball]))
            split = ~owned & ~leaf
            at, open_to = np.concatenate([self.left[at[split]], self.right[at[split]]]), np.concatenate([open_to[split]] * 2)
        none = [np.empty(0, np.int64)]
        return tuple(np.concatenate(v or none) for v in (balls, owner_of, points, nearest))

    def _nearest(self, rows: np.ndarray, entries: np.ndarray, open_to: np.ndarray) -> np.ndarray:
        return np.where(open_to, squares(self.points[rows], entries), math.inf).argmin(axis=1)

    def gathered(self, entries: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """Number of points of each entry and their sums."""
        balls, owner, rows, nearest = self.owners(entries)
        count = np.bincount(nearest, minlength=len(entries))
        np.add.at(count, owner, self.high[balls] - self.low[balls])
        exact = self.points[rows].astype(object if self.points.dtype == object else np.int64)
        total = np.zeros((len(entries), self.points.shape[1]), self.sums.dtype)
        np.add.at(total, nearest, exact)
        np.add.at(total, owner, self.sums[balls])
        return count, total.tolist()

    def codes(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each point, in the order of the rows the tree was made of."""
        balls, owner, rows, nearest = self.owners(entries)
        code = np.empty(len(self.points), np.int64)
        inside, ball = _stretches(self.low[balls], self.high[balls])
        code[inside], code[rows] = owner[ball], nearest
        wide = np.int64 if small(self.points, entries) else object
        off = self.points.astype(wide) - entries.astype(wide)[code]
        back = np.argsort(self.order)
        return code[back], (off * off).sum(axis=1)[back]


def _stretches(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of several stretches, and the number of the stretch of each."""
    size = high - low
    which = np.repeat(np.arange(len(low)), size)
    return np.arange(len(which)) - np.repeat(size.cumsum() - size, size) + low[which], which


def _top(x: np.ndarray) -> int:
    return int(np.abs(x).max(initial=0)) if x.size else 0


def small(x: np.ndarray, entries: np.ndarray) -> bool:
    """Whether every squared distance is a whole number that a double holds."""
    top = _top(x) + _top(entries)
    return x.shape[1] * top * top < 2**52


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all entries."""
    if small(x, entries):
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None]
    off = x.astype(object)[:, None, :] - entries.astype(object)[None]
    return (off * off).sum(axis=2)


class Codebooks(dict):
    """Entries of each part, by the length of the vectors: lists of lists of lists of integers."""

    def arrays(self, d: int) -> list[np.ndarray]:
        size = np.diff(edges(d, len(self[d])))
        narrow = all(abs(v) < 2**62 for part in self[d] for entry in part for v in entry)
        return [np.array(p, np.int64 if narrow else object).reshape(len(p), w) for p, w in zip(self[d], size)]

    def digest(self, d: int) -> str:
        numbers = (str(v) for part in self[d] for entry in part for v in entry)
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def packed(trees: list[Tree]) -> bytes:
    """The arrays alone, so any worker can read them."""
    return pickle.dumps([tuple(vars(t).values()) for t in trees], protocol=5)


def unpacked(trees: pa.BinaryScalar) -> list[Tree]:
    return [Tree(*fields) for fields in pickle.loads(trees.as_buffer())]


def _planter(parts: int, scale: int) -> Callable:
    """Chunks of vectors of one length with a tree for each part, one row a chunk."""

    def plant(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = defaultdict(list)

        def chunk(d: int) -> pa.RecordBatch:
            some = held.pop(d)
            x = scaled(np.concatenate([m for _, _, m in some]), scale)
            at = edges(d, parts)
            trees = packed([Tree.of(x[:, a:b]) for a, b in zip(at, at[1:])])
            lists = []
            for k in (0, 1):
                flat = pa.concat_arrays([s[k] for s in some])
                lists.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
            columns = [*lists, pa.array([d], pa.int32()), pa.array([trees], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["vec_ids", "labels", "d", "trees"])

        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                own = batch.filter(pa.array(lengths == d))
                most = max(1, CHUNK_VALUES // max(d, 1))
                for at in range(0, own.num_rows, most):
                    part = own.slice(at, most)
                    flat = part.column(2).flatten().to_numpy(zero_copy_only=False)
                    held[d].append((part.column(0), part.column(1), np.asarray(flat, np.float64).reshape(part.num_rows, d)))
                    if sum(len(m) for _, _, m in held[d]) >= most:
                        yield chunk(d)
        for d in list(held):
            yield chunk(d)

    return plant


def limbs(value: int) -> list[int]:
    """A whole number as digits to the base 2^LIMB, the last one with the sign; ordinary sums have one."""
    out = []
    while not -(2**LIMB) <= value < 2**LIMB:
        out.append(value & (2**LIMB - 1))
        value >>= LIMB
    return [*out, value]


def _gatherer(shared) -> Callable:
    """Counts and sums of all chunks of a task, added up in it."""

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = received(shared)
        arrays = {d: books.arrays(d) for d in books}
        counts, sums = defaultdict(int), defaultdict(int)
        for batch in batches:
            for d, trees in zip(batch.column(0).to_pylist(), batch.column(1)):
                for part, (tree, entries) in enumerate(zip(unpacked(trees), arrays[d])):
                    count, total = tree.gathered(entries)
                    for entry in np.flatnonzero(count).tolist():
                        counts[d, part, entry] += int(count[entry])
                        for place, value in enumerate(total[entry]):
                            sums[d, part, entry, place] += value
        rows = [(*key, -1, 0, n) for key, n in counts.items()]
        rows += [(*key, k, v) for key, value in sums.items() for k, v in enumerate(limbs(value))]
        columns = list(zip(*rows)) or [[]] * 6
        kinds = [pa.int32()] * 5 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["d", "part", "entry", "place", "limb", "v"])

    return gather


def _coder(shared) -> Callable:
    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = received(shared)
        arrays = {d: books.arrays(d) for d in books}
        for batch in batches:
            for k, (d, trees) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3))):
                found = [t.codes(e) for t, e in zip(unpacked(trees), arrays[d])]
                digits = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
                text, width = digits.tobytes().hex(), 2 * len(found)
                codes = [text[at : at + width] for at in range(0, len(text), width)]
                errors = [min(int(v), LARGEST) for v in sum(e for _, e in found).tolist()]
                ids, labels = batch.column(0)[k].values, batch.column(1)[k].values
                columns = [ids, labels, pa.array([d] * len(ids), pa.int32()), pa.array(codes, pa.string()), pa.array(errors, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "d", "code", "error"])

    return code


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``label`` and ``embedding`` in doubles of the rows whose vector has neither null nor non-finite components."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.cast("array<double>").alias("embedding"))
    return out.filter(F.coalesce(fine, F.lit(False)))


def _start(kept: DataFrame, parts: int, entries: int, scale: int) -> Codebooks:
    """The vectors with the smallest ids, for each length: at most ``entries`` rows a length reach the driver."""
    first = Window.partitionBy(F.size("embedding")).orderBy(F.col("vec_id").asc_nulls_last(), "embedding")
    rows = kept.select("vec_id", "embedding", F.row_number().over(first).alias("place")).filter(F.col("place") <= entries)
    books: dict[int, list] = defaultdict(list)
    for row in sorted(rows.collect(), key=lambda r: r.place):
        books[len(row.embedding)].append(row.embedding)
    out = Codebooks()
    for d, some in books.items():
        x, at = scaled(np.array(some, np.float64).reshape(len(some), d), scale), edges(d, parts)
        out[d] = [x[:, a:b].tolist() for a, b in zip(at, at[1:])]
    return out


def compress(
    vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> tuple[DataFrame, Codebooks]:
    """Columns ``vec_id``, ``label``, ``d``, ``code`` and ``error`` of the usable rows, and the codebooks.

    Components become floor(scale * x); a vector is cut into ``parts`` consecutive parts. A part position's codebook starts
    as that part of the ``entries`` smallest ids and is moved ``rounds`` times to the floor of the mean of the parts nearest to each
    entry (squared distance, ties to the lower entry); entries without parts stay. All of it is exact in integers, so the
    result does not depend on how the rows are dealt. ``code`` holds two hex digits a part, ``error`` the squared distances
    of the last assignment.

    One scan builds the trees, a chunk of vectors at a time, and writes them to the shared folder; each round reads them, adds up
    counts and sums inside its tasks and by one small grouping, and only codebooks (``entries`` times the length of a
    vector) reach the driver. No row is shuffled.

    Null vectors and those with null or non-finite components take no part. Fewer rows than ``entries`` give smaller
    codebooks. Null ids count as the largest; of rows that repeat an id the smaller vector comes first. Vectors of
    another length have codebooks of their own; a length that is no multiple of ``parts`` has longer parts first. Errors beyond
    2^63 - 1 are reported as that. An empty table gives no rows; other columns do not come along.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry has two hex digits: 1 to 256 entries")
    spark, kept = vectors.sparkSession, usable(vectors)
    label = kept.schema["label"].dataType.simpleString()
    shape = f"vec_ids array<long>, labels array<{label}>, d int, trees binary"
    chunks = settle(kept.mapInArrow(_planter(parts, scale), shape), "trees")
    books = _start(kept, parts, entries, scale)
    for _ in range(rounds):
        found = chunks.select("d", "trees").mapInArrow(
            _gatherer(sent(spark, books)), "d int, part int, entry int, place int, limb int, v long"
        )
        keys = ["d", "part", "entry", "place", "limb"]
        # A value per component of the codebooks, whatever the number of rows.
        total = found.groupBy(*keys).agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
        exact: dict[tuple, int] = defaultdict(int)
        for r in total:
            exact[r.d, r.part, r.entry, r.place] += int(r.v) << (LIMB * r.limb)
        moved = Codebooks()
        for d, book in books.items():
            moved[d] = [
                [
                    [exact[d, p, e, place] // n for place in range(len(entry))] if (n := exact.get((d, p, e, -1))) else entry
                    for e, entry in enumerate(part)
                ]
                for p, part in enumerate(book)
            ]
        books = moved
    shape = f"vec_id long, label {label}, d int, code string, error long"
    return chunks.mapInArrow(_coder(sent(spark, books)), shape), books
