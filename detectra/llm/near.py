"""MinHash near-dedup with sequential Bayesian verification.

Documents with equal shingle sets form a class and only its smallest document goes on.  Signatures
are banded into buckets.  A candidate pair's signatures are compared batch by batch: with a uniform
prior, m matches of n leave the similarity a Beta(m + 1, n - m + 1) posterior, and the pair is
dropped once the posterior chance of reaching the threshold is below the chosen miss probability.
Survivors are compared exactly on their full shingle sets, word by word.

Null or empty texts have no shingles and are linked with nothing.  A text of fewer words than a
shingle has its whole word sequence as its one shingle.  Each row is labelled by its own text; rows
that repeat a doc_id with another text are compared by the least of its texts.  Rows without a
doc_id are documents of their own, one for each text, and come before all others; ids below -2**62
stand for them.
"""

from __future__ import annotations

from collections.abc import Iterable
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph, scan, wire

U = np.uint64
ROWS, BANDS = 5, 32
BATCH = 32
MISS = 1e-9
#: A set element keeps 56 bits of its fingerprint; the other 8 number documents of a pass.
SET = U((1 << 56) - 1)
SIGNED = "doc_id long, n_shingles long, x long, y long, signature binary, bands binary"


def shingle_sets(texts: pa.Array, k: int) -> Iterable[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, after last, sorted distinct shingles, offsets by document) of passes over texts."""
    data, offsets = scan.column_bytes(texts)
    data = scan.LOWER[data]
    for i0, j0, _, _ in scan.passes(data, offsets):
        for i in range(i0, j0, 256):
            j = min(j0, i + 256)
            part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            s, e, by_doc = scan.words(part, off, scan.SPACES)
            n = np.diff(by_doc)
            values = scan.Prints(scan.Prints(part, 11).at(s, e), 12)
            at = scan.window_starts(by_doc, k)
            docs = np.repeat(np.arange(j - i), np.maximum(n - k + 1, 0))
            short = np.flatnonzero((n > 0) & (n < k))
            at, to = np.concatenate([at, by_doc[short]]), np.concatenate([at + k, by_doc[short + 1]])
            key = (values.at(at, to) >> U(8)) | (np.concatenate([docs, short]).astype(np.uint64) << U(56))
            key = np.unique(key)
            yield i, j, key & SET, np.searchsorted(key >> U(56), np.arange(j - i + 1))


def _rows(ids: np.ndarray, texts: pa.Array, k: int) -> pa.Table:
    r = np.random.default_rng(2024)
    size = ROWS * BANDS
    xor, mul = r.integers(0, 2**32, size, dtype=np.uint32), r.integers(0, 2**31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    salt = r.integers(0, 2**63, BANDS, dtype=np.uint64)
    count, x, y = (np.zeros(len(ids), np.uint64) for _ in range(3))
    sig: list[bytes | None] = [None] * len(ids)
    bands: list[bytes | None] = [None] * len(ids)
    for i, j, items, off in shingle_sets(texts, k):
        n = np.diff(off)
        live = np.flatnonzero(n)
        count[i:j] = n
        if not len(live):
            continue
        at = off[live]
        x[i + live] = np.add.reduceat(scan.mix(items ^ U(0x51)), at)
        y[i + live] = np.add.reduceat(scan.mix(items ^ U(0xA7)), at)
        low = (items >> U(24)).astype(np.uint32)
        s = np.empty((len(live), size), np.uint32)
        for c in range(size):
            v = (low ^ xor[c]) * mul[c]
            v ^= v >> np.uint32(15)
            s[:, c] = np.minimum.reduceat(v, at)
        wide = s.reshape(len(live), BANDS, ROWS).astype(np.uint64)
        key = salt[None, :] + np.zeros((len(live), 1), np.uint64)
        for c in range(ROWS):
            key = scan.mix(key * U(0x9E3779B97F4A7C15) + wide[:, :, c])
        byte = (s * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
        for d, a, b in zip((i + live).tolist(), byte, key):
            sig[d], bands[d] = a.tobytes(), b.tobytes()
    return pa.table({"doc_id": pa.array(ids), "n_shingles": pa.array(count.astype(np.int64)), "x": pa.array(x.view(np.int64)), "y": pa.array(y.view(np.int64)), "signature": pa.array(sig, pa.binary()), "bands": pa.array(bands, pa.binary())})


def signatures(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            yield from _rows(np.asarray(b.column("doc_id"), np.int64), b.column("text"), k).to_batches()

    return docs.select("doc_id", "text").mapInArrow(run, SIGNED)


def least_matches(threshold: float, batches: int, miss: float) -> list[int]:
    """For each batch, the fewest matches so far with which a pair may still reach the threshold.

    P(similarity >= t | m of n) is the chance that n + 1 draws with probability t succeed at most m
    times.  A signature keeps one byte of each minimum, so unlike minima match once in 256.
    """
    t = Fraction(threshold).limit_denominator(1000)
    t = t + (1 - t) / 256
    out = []
    for b in range(1, batches + 1):
        n, total, m = b * BATCH + 1, Fraction(0), 0
        while True:
            total += comb(n, m) * t**m * (1 - t) ** (n - m)
            if total >= miss:
                break
            m += 1
        out.append(m)
    return out


def prune(least: list[int]):
    """Keeps (a, b) rows whose signatures sa and sb have the least matches of each batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, ROWS * BANDS) for c in ("sa", "sb"))
            live = np.arange(len(x))
            matches = np.zeros(len(x), np.int64)
            for i, need in enumerate(least):
                part = slice(i * BATCH, (i + 1) * BATCH)
                matches[live] += (x[live, part] == y[live, part]).sum(1)
                live = live[matches[live] >= need]
            yield b.select(["a", "b"]).take(pa.array(live))

    return run


def set_list(texts: pa.Array, k: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, items, off in shingle_sets(texts, k):
        out += np.split(items, off[1:-1])
    return out


LOWER_BYTES = scan.LOWER.tobytes()


def true_set(text: str, k: int) -> set[tuple[bytes, ...]]:
    w = text.encode().translate(LOWER_BYTES).split()
    return set(zip(*(w[i:] for i in range(k)))) if len(w) >= k else {tuple(w)}


def exactly(k: int, percent: int):
    """Keeps (a, b) rows whose texts ta and tb have 100 * intersection >= percent * union, of true words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            b = b.take(pc.sort_indices(b.column("a")))
            last, p, good = None, set(), []
            for a, ta, tb in zip(b.column("a").to_pylist(), b.column("ta"), b.column("tb")):
                if a != last:
                    last, p = a, true_set(ta.as_py(), k)
                q = true_set(tb.as_py(), k)
                both = len(p & q)
                good.append(both > 0 and 100 * both >= percent * (len(p) + len(q) - both))
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def node_of() -> F.Column:
    """The row's doc_id; where it has none, a number below -2**62 made from its text."""
    own = F.pmod(F.xxhash64(F.col("text").cast("string")), F.lit(2**62)) + F.lit(-(2**63) + 1)
    return F.coalesce(F.col("doc_id").cast("long"), own)


def real_id(name: str) -> F.Column:
    return F.when(F.col(name) >= -(2**62), F.col(name))


def wanted_texts(dealt: DataFrame, nodes: DataFrame, chunks: int) -> DataFrame:
    """(node, text) of the wanted ids, which go to their chunks; of rows of one id, the first."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return wire.empty("node long, text string")
        ids, texts = wire.open_chunk(left.column("body"))
        at = np.searchsorted(ids, want := np.unique(np.asarray(right.column("node"), np.int64)))
        return pa.table({"node": pa.array(want), "text": texts.take(pa.array(at)).cast(pa.string())})

    sent = nodes.select("node", F.pmod(F.xxhash64("node"), F.lit(chunks)).cast("int").alias("chunk"))
    return dealt.groupBy("chunk").cogroup(sent.groupBy("chunk")).applyInArrow(run, "node long, text string")


def find(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id, kept, class_id.

    component_id is the smallest doc_id that links of ``percent`` similarity reach; kept is
    doc_id = component_id, of rows without ids true for the smallest; class_id is the smallest doc_id
    with an equal shingle set.
    """
    return labelled(docs, shingle, percent).select(
        real_id("doc_id").alias("doc_id"),
        "n_shingles",
        real_id("component").alias("component_id"),
        (F.col("doc_id") == F.col("component")).alias("kept"),
        real_id("class").alias("class_id"),
    )


def keep(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows, with all their columns, of the smallest document of each component; of repeated rows one."""
    kept = labelled(docs, shingle, percent).filter("doc_id = component").select(F.col("doc_id").alias("node_")).distinct()
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), node_of().alias("node"), F.xxhash64("text").alias("print"))
    rows = rows.join(kept, F.col("node") == F.col("node_"), "left_semi")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("node", "print").orderBy("print")))
    return rows.filter("place = 1").select(*[F.col(f"row.`{c}`").alias(c) for c in names])


def labelled(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, class, component) of each row, where doc_id is node_of()."""
    rows = docs.select(node_of().alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = wire.pieces(docs)
    signed = wire.cut(signatures(rows, shingle).withColumn("k", F.struct("n_shingles", "x", "y")))
    classes = signed.filter("n_shingles > 0").groupBy("k").agg(F.min(F.struct("doc_id", "signature", "bands")).alias("r"))
    classes = wire.cut(classes.select("k", F.col("r.doc_id").alias("node"), F.col("r.signature").alias("signature"), F.col("r.bands").alias("bands")))
    spread = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("i")
    buckets = classes.select("node", "bands", spread).select(F.substring("bands", F.col("i") * 8 + 1, F.lit(8)).alias("key"), "node")
    often = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("key").alias("k"))
    buckets = wire.cut(buckets.join(often, F.col("key") == F.col("k"), "left_semi"))
    marks = classes.select(F.col("node").alias("k_"), "signature")
    least = least_matches(percent / 100, ROWS * BANDS // BATCH, MISS)
    dealt = wire.dealt_table(rows, chunks, by_id=True)

    def verify(pairs: DataFrame) -> DataFrame:
        near = pairs.join(marks, F.col("b") == F.col("k_")).select("a", "b", F.col("signature").alias("sb"))
        near = graph.looked_up(near, "a", "b", marks, keys=pairs).withColumnRenamed("signature", "sa")
        near = wire.cut(near.mapInArrow(prune(least), "a long, b long"))
        nodes = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
        texts = wanted_texts(dealt, nodes, chunks)
        full = near.join(texts.withColumnRenamed("text", "tb"), F.col("b") == F.col("node")).select("a", "b", "tb")
        full = graph.looked_up(full, "a", "b", texts.select(F.col("node").alias("k_"), F.col("text").alias("ta")), keys=near)
        return full.mapInArrow(exactly(shingle, percent), "a long, b long")

    def alike(left: DataFrame) -> DataFrame:
        return graph.alike(left.join(marks, F.col("node") == F.col("k_")).drop("k_"), least, BATCH)

    nodes = graph.settle(buckets, verify, lambda n: wanted_texts(dealt, n, chunks), lambda t: set_list(t, shingle), percent, alike)
    of_class = classes.select(F.col("k").alias("k_"), F.col("node").alias("class")).join(nodes, F.col("class") == F.col("node"), "left")
    of_class = of_class.select("k_", "class", F.coalesce("component", "class").alias("component"))
    out = graph.looked_up(signed.select("doc_id", "n_shingles", "k"), "k", "doc_id", of_class, "left")
    return out.select("doc_id", "n_shingles", "class", F.coalesce("component", "doc_id").alias("component"))
