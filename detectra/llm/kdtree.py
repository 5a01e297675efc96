"""Centroid clustering by kd-tree filtering.

Vectors become whole numbers and are packed into kd-trees of bounded size, whose nodes hold counts,
sums, squared sums and boxes; the trees are a table in the shared folder.  In each round a task walks
its trees with the centroids: a centroid strictly farther than another one from every point of a box
is pruned, a node with one centroid left is assigned whole, and in leaves the rest is compared
exactly.  Tasks send the sum and count of each centroid only, and the driver holds k centroids.

All arithmetic is exact: in doubles where every intermediate is below 2**53, else in Python's whole
numbers.  Vectors that are null, of another length, or have an entry that is null, not finite or
too large for a long are left out.  Rows without an id take part; their start hash is that of the
seed alone, and rows of equal hashes are ordered by their vectors.  With fewer rows than ``k`` there
are as many centroids as rows.  Repeated rows each count, and other columns are ignored.  Distances
or inertias beyond a long are null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors, wire

#: Points of a tree, and of a leaf.
TREE, LEAF = 8192, 48
SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def build(ids: np.ndarray, points: np.ndarray) -> bytes:
    """A tree as bytes: points in tree order, and for each node its range, its children and its box."""
    n, order = len(points), np.arange(len(points))
    start, end, child = [0], [n], []
    at = 0
    while at < len(start):
        s, e = start[at], end[at]
        own = points[order[s:e]]
        spread = own.max(0).astype(np.float64) - own.min(0)
        axis = int(np.argmax(spread))
        if e - s <= LEAF or spread[axis] <= 0:
            child.append(0)
        else:
            half = (e - s) // 2
            order[s:e] = order[s:e][np.argpartition(own[:, axis], half)]
            child.append(len(start))
            start += [s, s + half]
            end += [s + half, e]
        at += 1
    points = points[order]
    low = np.stack([points[s:e].min(0) for s, e in zip(start, end)])
    high = np.stack([points[s:e].max(0) for s, e in zip(start, end)])
    base = points.min(0)
    return wire.pack(ids[order], base, wire.narrow((points - base).ravel()), np.array(start, np.int32), np.array(end, np.int32), np.array(child, np.int32), low.ravel(), high.ravel())


class Tree:
    """A tree opened for centroids of at most ``reach`` in any component."""

    def __init__(self, body: bytes, reach: int):
        self.ids, base, points, self.start, self.end, self.child, low, high = wire.unpack(body)
        d = len(base)
        top = max(reach, int(np.abs(low.astype(object)).max()), int(np.abs(high.astype(object)).max()))
        kind = np.float64 if 8 * d * max(len(self.ids), 8) * top * top < 2**53 else object
        self.points = (points.reshape(-1, d).astype(np.int64) + base).astype(kind)
        self.low, self.high = low.reshape(-1, d).astype(kind), high.reshape(-1, d).astype(kind)
        # Sums of nodes are differences of running sums, which are exact.
        zero = np.zeros((1, d), kind)
        running = np.concatenate([zero, np.cumsum(self.points, 0)])
        squares = np.concatenate([zero[:, 0], np.cumsum((self.points * self.points).sum(1))])
        self.total, self.square = running[self.end] - running[self.start], squares[self.end] - squares[self.start]
        self.kind = kind

    def walk(self, centroids: np.ndarray) -> Iterator[tuple[int, int | np.ndarray]]:
        """(node, which): nodes that cover all points, with the one centroid of their points or that of each."""
        c = centroids.astype(self.kind)
        norm = (c * c).sum(1)
        stack = [(0, np.arange(len(c)))]
        while stack:
            node, left = stack.pop()
            if len(left) > 1:
                low, high = self.low[node], self.high[node]
                from_mid = norm[left] - c[left] @ (low + high)
                best = left[int(np.argmin(from_mid))]
                toward = c[left] - c[best]
                corner = np.where(toward > 0, high, low)
                left = left[norm[left] - norm[best] - 2 * (toward * corner).sum(1) <= 0]
            if len(left) == 1:
                yield node, int(left[0])
            elif not self.child[node]:
                own = self.points[self.start[node] : self.end[node]]
                yield node, left[np.argmin((norm[left] - 2 * (own @ c[left].T)).astype(self.kind), 1)]
            else:
                stack += [(int(self.child[node]), left), (int(self.child[node]) + 1, left)]

    def sums(self, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
        """For each centroid with points: count, sum of squared distances, and sum of the points."""
        k, d = centroids.shape
        count, square, total = np.zeros(k, np.int64), np.zeros(k, self.kind), np.zeros((k, d), self.kind)
        label = np.full(len(self.ids), -1)
        for node, which in self.walk(centroids):
            if isinstance(which, int):
                count[which] += self.end[node] - self.start[node]
                square[which] += self.square[node]
                total[which] += self.total[node]
            else:
                label[self.start[node] : self.end[node]] = which
        rest = np.flatnonzero(label >= 0)
        own, member = self.points[rest], np.zeros((len(rest), k), self.kind)
        member[np.arange(len(rest)), label[rest]] = 1
        count += np.bincount(label[rest], minlength=k)
        square += member.T @ (own * own).sum(1)
        total += member.T @ own
        out = {}
        for i in np.flatnonzero(count).tolist():
            n, sums, c = int(count[i]), [int(x) for x in total[i]], centroids[i].tolist()
            out[i] = n, int(square[i]) - 2 * sum(x * y for x, y in zip(sums, c)) + n * sum(x * x for x in c), sums
        return out

    def labels(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The centroid of each point and its squared distance."""
        label = np.zeros(len(self.ids), np.int64)
        for node, which in self.walk(centroids):
            label[self.start[node] : self.end[node]] = which
        apart = self.points - centroids.astype(self.kind)[label]
        return label, (apart * apart).sum(1)


@dataclass
class Clusters:
    """Trees, final centroids (whole numbers), and for each centroid its points and its inertia."""

    trees: DataFrame
    centroids: np.ndarray
    count: list[int]
    inertia: list[int]


def integer_vectors(table: DataFrame, scale: float, dim: int) -> DataFrame:
    """(vec_id, x) of the usable rows; missing ids are NULL_ID."""
    rows = table.filter(vectors.usable(F.col("embedding"), scale) & (F.size("embedding") == dim))
    return rows.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(wire.NULL_ID)).alias("vec_id"), vectors.integers(F.col("embedding"), scale).alias("x"))


def grow(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    held, n = [], 0

    def planted() -> pa.RecordBatch:
        ids, points = (np.concatenate(x) for x in zip(*held))
        return pa.record_batch({"body": pa.array([build(ids, points)], pa.binary())})

    for b in batches:
        for s in range(0, b.num_rows, TREE):
            part = b.slice(s, TREE)
            if n + part.num_rows > TREE:
                yield planted()
                held, n = [], 0
            held.append((np.asarray(part.column("vec_id")), vectors.matrix(part.column("x"))))
            n += part.num_rows
    if n:
        yield planted()


def visit(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """Count, inertia and sum of the points of each centroid that has any."""
    reach = max(abs(int(x)) for x in centroids.ravel())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        found: dict[int, tuple[int, int, list[int]]] = {}
        for b in batches:
            for body in b.column("body"):
                for k, (n, far, total) in Tree(body.as_py(), reach).sums(centroids).items():
                    m, was, sums = found.get(k, (0, 0, [0] * len(total)))
                    found[k] = m + n, was + far, [x + y for x, y in zip(sums, total)]
        for k, (n, far, total) in sorted(found.items()):
            yield vectors.sent(k, vectors.split([n, far & vectors.LOW, far >> 32, *total]))

    out = {}
    for k, body in vectors.summed(trees.mapInArrow(run, vectors.SUMS), np.int64).items():
        n, low, high, *total = vectors.joined(body)
        out[k] = n, low + (high << 32), total
    return out


def fit(table: DataFrame, k: int = 40, rounds: int = 5, scale: float = 256, dim: int = 64, seed: int = 2) -> Clusters:
    """Lloyd's rounds from the k rows with the smallest SHA-256 of ``seed:vec_id``.

    A round assigns each vector to the nearest centroid, of equally near ones the first, and moves each
    centroid that has vectors to the floor of their mean.
    """
    rows = integer_vectors(table, scale, dim)
    own = F.when(F.col("vec_id") == wire.NULL_ID, F.lit("")).otherwise(F.col("vec_id").cast("string"))
    hashed = rows.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), own), 256))
    first = hashed.orderBy("hash", "x").select("x").limit(k).collect()
    trees = wire.cut(rows.mapInArrow(grow, "body binary"))
    centroids = np.array([r["x"] for r in first], np.int64).reshape(-1, dim)
    if not len(centroids):
        return Clusters(trees, centroids, [], [])
    for _ in range(rounds):
        for i, (n, _, total) in visit(trees, centroids).items():
            centroids[i] = [x // n for x in total]
    last = visit(trees, centroids)
    return Clusters(trees, centroids, [last[i][0] if i in last else 0 for i in range(len(first))], [last[i][1] if i in last else 0 for i in range(len(first))])


def assign(model: Clusters) -> DataFrame:
    """One row for each vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    c = model.centroids
    reach = max([0, *(abs(int(x)) for x in c.ravel())])
    prints = [sha256(",".join(map(str, x)).encode()).hexdigest() for x in c.tolist()]
    fits = lambda x: x if x < 2**63 else None
    inertia, whole = model.inertia, fits(sum(model.inertia))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        own, digests = pa.array([fits(x) for x in inertia], pa.int64()), pa.array(prints, pa.string())
        for b in batches:
            for body in b.column("body"):
                t = Tree(body.as_py(), reach)
                label, far = t.labels(c)
                at = pa.array(label)
                yield pa.record_batch(
                    {
                        "vec_id": pa.array(t.ids),
                        "cluster": at.cast(pa.int32()),
                        "distance": pa.array(far.astype(np.int64)) if t.kind is np.float64 else pa.array([fits(int(x)) for x in far], pa.int64()),
                        "cluster_inertia": own.take(at),
                        "inertia": pa.array([whole] * len(t.ids), pa.int64()),
                        "centroid_sha256": digests.take(at),
                    }
                )

    return model.trees.mapInArrow(run, SCHEMA).withColumn("vec_id", wire.real_id("vec_id"))


def cluster(table: DataFrame, k: int = 40, rounds: int = 5, scale: float = 256, dim: int = 64, seed: int = 2) -> DataFrame:
    """fit() and assign() of a table's ``vec_id`` and ``embedding`` columns."""
    return assign(fit(table, k, rounds, scale, dim, seed))
