"""Candidate pairs from LSH buckets without all pairs of a bucket, and distributed union-find.

A key may hold any share of all rows, so rows never meet their key's figures by the key alone: they
are dealt by the key and one of ``SALTS`` salts, and the figures go to the salts that the key has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan, wire

SALTS = 64
#: Queries and nodes of a block, where sets are compared and where signatures are.
SETS, SIGNATURES = (256, 1024), (512, 2048)
#: Queries times shingles that are looked up at a time.
MEET = 1 << 22


def salted(rows: DataFrame, spread: str) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))


def seen_salts() -> Column:
    return F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts")


def each_salt() -> Column:
    return F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> getbit(salts, s) = 1)")).alias("s_")


def beside(rows: DataFrame, key: str, spread: str, **figures: Column) -> DataFrame:
    """The rows with aggregates over all rows of their key."""
    dealt = salted(rows, spread)
    groups = dealt.groupBy(F.col(key).alias("k_")).agg(*[v.alias(k) for k, v in figures.items()], seen_salts()).select("k_", *figures, each_salt())
    return dealt.join(groups, (F.col(key) == F.col("k_")) & (F.col("salt") == F.col("s_"))).drop("k_", "s_", "salt")


def looked_up(rows: DataFrame, key: str, spread: str, table: DataFrame, how: str = "inner", keys: DataFrame | None = None) -> DataFrame:
    """The rows with the columns of a table that has one row, of column ``k_``, for a key.

    ``keys`` may name a cheaper frame with the rows' keys.
    """
    dealt = salted(rows, spread)
    salts = salted(keys or rows, spread).groupBy(F.col(key).alias("own_")).agg(seen_salts())
    right = table.join(salts, F.col("k_") == F.col("own_")).select(*table.columns, each_salt())
    return dealt.join(right, (F.col(key) == F.col("k_")) & (F.col("salt") == F.col("s_")), how).drop("k_", "s_", "salt")


def forest(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """(hi, lo, moved): each node of the partition's edges but the smallest of a tree, with that smallest.

    ``moved`` tells whether this, or a jump before, changed any edge of the partition.
    """
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    edges, moved = 0, False
    for b in batches:
        moved |= any(b.column("moved").to_pylist())
        for hi, lo in zip(b.column("hi").to_pylist(), b.column("lo").to_pylist()):
            x, y = find(hi), find(lo)
            moved |= x == y or x != hi or y != lo
            if x != y:
                parent[max(x, y)] = min(x, y)
                edges += 1
    nodes = np.fromiter(parent, np.int64, len(parent))
    roots = np.fromiter((find(x) for x in parent), np.int64, len(parent))
    for s in range(0, len(nodes), 1 << 16):
        n = len(nodes[s : s + (1 << 16)])
        yield pa.record_batch({"hi": pa.array(nodes[s : s + n]), "lo": pa.array(roots[s : s + n]), "moved": pa.array(np.full(n, moved))})


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of (a, b) links but the smallest of each component, which is its name.

    Each task first reduces its own edges to stars.  A round then lets every edge jump from its lower
    end to that node's smallest neighbour, deals edges by their higher end and reduces them again; a
    task names a node once, so no higher end has more edges than there are tasks, and lower ends, which
    may have any number, are salted.  Depth halves each round; a round is one written table and a look
    whether anything moved.  Nothing is collected.
    """
    spark = links.sparkSession
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"), F.lit(True).alias("moved"))
    schema = "hi long, lo long, moved boolean"
    table, path = wire.stored(edges.mapInArrow(forest, schema))
    while not table.filter("moved").isEmpty():
        up = table.groupBy(F.col("hi").alias("k_")).agg(F.min("lo").alias("up"))
        jumped = looked_up(table.select("hi", "lo"), "lo", "hi", up, "left").select("hi", F.coalesce("up", "lo").alias("lo"), F.col("up").isNotNull().alias("moved"))
        old = path
        table, path = wire.stored(jumped.groupBy("hi", "lo").agg(F.max("moved").alias("moved")).repartition("hi").mapInArrow(forest, schema))
        wire.discard(spark, old)
    return table.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


def stars(buckets: DataFrame) -> DataFrame:
    """Pairs of each bucket's smallest node with its others, of (key, node) rows."""
    return beside(buckets, "key", "node", a=F.min("node")).filter("node <> a").select("a", F.col("node").alias("b")).distinct()


def leftovers(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """(hub, node, c): nodes of buckets that hold several components after the stars were checked.

    A bucket's hub is its largest component there.  Every pair of unlike components in a bucket has
    a node outside of the hub, and both of its nodes are listed under the hub.  Pairs with the
    smallest node were the star.
    """
    live = beside(buckets, "key", "node", pivot=F.min("node"), n=F.count(F.lit(1))).filter("n > 2 and node <> pivot").select("key", "node")
    live = wire.cut(live.join(found.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left").select("key", "node", F.coalesce("component", "node").alias("c")))
    sizes = live.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.groupBy("key").agg(F.max(F.struct("n", "c")).alias("top"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select(F.col("key").alias("k_"), F.col("top.c").alias("hub"))
    return looked_up(live, "key", "node", large).select("hub", "node", "c").distinct()


def blocks(rows: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """Rows of (hub, node, c) as the nodes outside of a hub that ask, and all of its nodes, dealt into blocks (i, j).

    About so many of either meet in a block, so neither a task nor a row holds more.
    """
    sized = beside(rows, "hub", "node", q=F.sum((F.col("c") != F.col("hub")).cast("long")), n=F.count(F.lit(1)))
    nq, nn = (F.ceil(F.col(x) / size).cast("int") for x, size in zip(("q", "n"), sizes))
    sized = sized.withColumn("nq", nq).withColumn("nn", nn).withColumn("h", F.xxhash64("node"))
    each = lambda top: F.explode(F.sequence(F.lit(0), F.col(top) - 1))
    rest = [x for x in rows.columns if x != "hub"]
    ask = sized.filter("c <> hub").select("hub", F.pmod("h", "nq").cast("int").alias("i"), each("nn").alias("j"), *rest, F.lit(True).alias("asks"))
    return ask.unionByName(sized.select("hub", each("nq").alias("i"), F.pmod("h", "nn").cast("int").alias("j"), *rest, F.lit(False).alias("asks")))


def alike(rows: DataFrame, least: list[int], batch: int) -> DataFrame:
    """The (hub, node, c) of rows with signatures that have a partner which signatures alone don't rule out.

    Signatures are compared batch by batch; a pair with fewer matches so far than ``least`` says is out.
    """

    def meet(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        asks, node, c = (np.asarray(t.column(x)) for x in ("asks", "node", "c"))
        sig = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint8).reshape(len(node), -1)
        queries, others = np.flatnonzero(asks), np.flatnonzero(~asks)
        good = np.zeros(len(node), bool)
        for q in queries.tolist():
            live = others[c[others] != c[q]]
            matches = np.zeros(len(live), np.int64)
            for i, need in enumerate(least):
                part = slice(i * batch, (i + 1) * batch)
                matches += (sig[live, part] == sig[q, part]).sum(1)
                ok = matches >= need
                live, matches = live[ok], matches[ok]
                if not len(live):
                    break
            good[live] = True
            good[q] |= len(live) > 0
        return t.select(["hub", "node", "c"]).filter(pa.array(good))

    return wire.runs_of(blocks(rows, SIGNATURES), ["hub", "i", "j"], meet, "hub long, node long, c long").distinct()


def cross_links(rows: DataFrame, sets_of: Callable[[pa.Array], list[np.ndarray]], percent: int) -> DataFrame:
    """(a, b) links between components of (hub, node, c, text) rows, found block by block.

    Pairs are counted inside of a task and not emitted.  A query gives one link to each component.
    """

    def meet(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        asks = np.asarray(t.column("asks"))
        sets = sets_of(t.column("text").chunk(0))
        node, c = np.asarray(t.column("node")), np.asarray(t.column("c"))
        queries, others = np.flatnonzero(asks), np.flatnonzero(~asks)
        links: dict[tuple[int, int], tuple[int, int]] = {}
        if len(queries):
            size = np.array([len(sets[x]) for x in queries])
            items = np.concatenate([sets[x] for x in queries])
            owner = np.repeat(np.arange(len(queries)), size)
            order = np.argsort(items, kind="stable")
            items, owner = items[order], owner[order]
            first = np.flatnonzero(np.append(True, items[1:] != items[:-1]))
            known, times = items[first], np.diff(np.append(first, len(items)))
            weight = np.cumsum([len(sets[x]) for x in others])
            at = 0
            while at < len(others):  # about MEET shingles at a time
                to = max(at + 1, int(np.searchsorted(weight, (weight[at - 1] if at else 0) + MEET // len(queries), "right")))
                own = others[at:to]
                at = to
                told = np.concatenate([sets[x] for x in own])
                near = np.minimum(np.searchsorted(known, told), len(known) - 1)
                same = np.flatnonzero(known[near] == told)
                near = near[same]
                teller = np.repeat(np.arange(len(own)), [len(sets[x]) for x in own])[same]
                cell = np.repeat(teller, times[near]) * len(queries) + owner[scan.ranges(first[near], times[near])]
                both = np.bincount(cell, minlength=len(own) * len(queries)).reshape(len(own), -1)
                total = size[None, :] + np.array([len(sets[x]) for x in own])[:, None] - both
                good = (both > 0) & (100 * both >= percent * total) & (c[own][:, None] != c[queries][None, :])
                for i, j in zip(*np.nonzero(good)):
                    x, y = own[i], queries[j]
                    links.setdefault((int(node[y]), int(c[x])), (int(min(node[y], node[x])), int(max(node[y], node[x]))))
        found = sorted(set(links.values()))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return wire.runs_of(blocks(rows, SETS), ["hub", "i", "j"], meet, "a long, b long").distinct()


def settle(
    buckets: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    texts: Callable[[DataFrame], DataFrame],
    sets_of: Callable[[pa.Array], list[np.ndarray]],
    percent: int,
    prune: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(node, component) over all links of ``percent`` similarity within buckets, but for the components' smallest nodes.

    verify maps (a, b) candidate pairs to the true links; texts gives (node, text) of wanted nodes;
    prune, of (hub, node, c), those that may have a link in their hub.
    """
    found = components(verify(wire.cut(stars(buckets))))
    left = wire.cut(leftovers(buckets, found))
    if left.isEmpty():
        return found
    left = wire.cut(prune(left)) if prune else left
    body = texts(left.select("node").distinct()).select(F.col("node").alias("n"), "text")
    extra = verify(wire.cut(cross_links(left.join(body, F.col("node") == F.col("n")).drop("n"), sets_of, percent)))
    return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(extra))
