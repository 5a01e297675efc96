"""Fuzzy line dedup: MinHash over character shingles, exact Jaccard, union-find, one line each.

A chunk's distinct lines are signed by one-permutation hashing, banded, and the band keys dealt to
buckets; keys of one line only end there.  Candidate lines are compared exactly by their shingle
sets, linked lines are joined by union-find, and of each component the first line in order of
doc_id and line number stays.  Lines shorter than ``least`` bytes are left alone, or with ``whole``
only blank lines: then lines too short for a shingle are joined if they are equal.

A null text has no lines and stays null.  Equal lines of different chunks are found by 128-bit
cryptographic digests in the same exchange, so only unlike lines are banded together and compared.
A shingle is eight bytes and so a number of its own: comparisons of shingle sets are exact.
"""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import graph, scan, wire

U = np.uint64
ROWS, BANDS = 4, 12
SHINGLE = 8
#: Bytes of lines that one vectorised pass works on, which a core's cache holds.
PASS = 1 << 17
SCHEMA = "doc_id long, n_lines long, n_removed long, removed array<int>, kept_text string"


class Lines:
    """Distinct lines of a chunk in order of first occurrence, with all their places.

    A ``least`` of 0 takes all lines that are not blank.
    """

    def __init__(self, ids: np.ndarray, texts: pa.Array, least: int):
        self.ids = ids
        data, offsets = scan.column_bytes(texts)
        raw = data.tobytes()
        self.valid = np.asarray(texts.is_valid())
        self.texts = [raw[s:e].split(b"\n") for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        known: dict[bytes, int] = {}
        self.which: list[list[int]] = []
        self.first: list[tuple[int, int]] = []
        for d, own in enumerate(self.texts):
            row = []
            for n, line in enumerate(own):
                if len(line) < least or not least and not line.strip():
                    row.append(-1)
                    continue
                c = known.setdefault(line, len(known))
                if c == len(self.first):
                    self.first.append((d, n))
                row.append(c)
            self.which.append(row)
        self.distinct = list(known)


def line_digests(lines: list[bytes]) -> np.ndarray:
    """Cryptographic digests of whole lines, of two 64-bit numbers each."""
    return np.frombuffer(b"".join([blake2b(x, digest_size=16).digest() for x in lines]), np.uint64).reshape(-1, 2)


def band_keys(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and line numbers: the smallest shingle number of each of ROWS * BANDS parts of the hash range.

    Empty parts borrow from the next part that has one, by rotation.
    """
    bins = ROWS * BANDS
    keys, owners = [], []
    data = np.frombuffer(b"".join(lines), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)
    for i, j, part, off in scan.passes(data, offsets, PASS):
        n = len(part) - SHINGLE + 1
        if n <= 0:
            continue
        # A shingle's hash times the number of parts: its part, and its place there, which the smallest wins.
        packed = (scan.mix(scan.loads(part)[:n]) >> U(32)) * U(bins)
        line = np.repeat(np.arange(j - i, dtype=np.uint64) * U(bins << 32), np.diff(off))[:n]
        cross = (off[1:-1, None] - np.arange(1, SHINGLE)).ravel()
        line[cross[(cross >= 0) & (cross < n)]] = U((j - i) * bins << 32)
        packed += line
        packed.sort()
        slot = packed >> U(32)
        first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        table = np.full((j - i + 1) * bins, -1, np.int64)
        table[slot[first].astype(np.int64)] = (packed[first] & U(0xFFFFFFFF)).astype(np.int64)
        table = table[: (j - i) * bins]
        table = table.reshape(j - i, bins)
        live = np.flatnonzero((table >= 0).any(1))
        table = table[live]
        place = np.where(np.concatenate([table, table], 1) >= 0, np.arange(2 * bins), 4 * bins)
        nearest = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :bins]
        gap = (nearest - np.arange(bins)).astype(np.uint64)
        value = np.take_along_axis(table, nearest % bins, 1).astype(np.uint64) + gap * U(0x9E3779B97F4A7C15)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(live), BANDS)).copy()
        for c in range(ROWS):
            key = scan.mix(key * U(0x9E3779B97F4A7C15) + value.reshape(len(live), BANDS, ROWS)[:, :, c])
        keys.append(key.ravel())
        owners.append(np.repeat(live + i, BANDS))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def meet(chunks: int):
    """What a bucket finds among the chunks' lines: (key, node, rep) rows.

    A node is chunk * 2**32 + line.  Buckets of whole-line digests give (null, node, rep) for
    lines that equal another chunk's; rep is the smallest node.  Buckets of band keys give (key,
    node, null) for keys that unlike lines have, where equal lines count as the smallest node.
    """

    def run(t: pa.Table) -> pa.Table:
        parts = [(np.int64(c) << 32, wire.unpack(b)) for c, b in zip(t.column("chunk").to_pylist(), t.column("body").to_pylist())]
        bucket = t.column("bucket")[0].as_py()
        node = np.concatenate([c + p[-1].astype(np.int64) for c, p in parts])
        x, y = (np.concatenate([p[i] for _, p in parts]).astype(np.uint64) for i in (0, 1))
        if bucket < chunks:
            x = x << U(8) | y
            y = np.concatenate([p[2] for _, p in parts]).astype(np.uint64)
        order = np.lexsort((node, y, x))
        x, y, node = x[order], y[order], node[order]
        new_x = np.ones(len(x), bool)
        new_x[1:] = x[1:] != x[:-1]
        new = new_x.copy()
        new[1:] |= y[1:] != y[:-1]
        if bucket < chunks:
            x, node, new_x = x[new], node[new], new_x[new]
            some = np.diff(np.append(np.flatnonzero(new_x), len(x)))[np.cumsum(new_x) - 1] > 1
            key = (x[some] + U(bucket << 40)).view(np.int64)
            return pa.table({"key": pa.array(key), "node": pa.array(node[some]), "rep": pa.array([None] * int(some.sum()), pa.int64())})
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        some = np.diff(np.append(first, len(x)))[group] > 1
        return pa.table({"key": pa.array([None] * int(some.sum()), pa.int64()), "node": pa.array(node[some]), "rep": pa.array(node[first][group][some])})

    return run


def set_list(lines: pa.Array) -> list[np.ndarray]:
    return [true_set(x) for x in lines.to_pylist()]


def true_set(line: bytes) -> np.ndarray:
    """Distinct shingles as sorted numbers of their eight bytes."""
    x = np.sort(scan.loads(np.frombuffer(line, np.uint8))[: max(0, len(line) - SHINGLE + 1)])
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def exactly(percent: int):
    """Keeps (a, b) rows whose lines ta and tb have so similar sets of shingles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            b = b.take(pc.sort_indices(b.column("a")))
            last, p, good = None, np.zeros(0, np.uint64), []
            for a, ta, tb in zip(b.column("a").to_pylist(), b.column("ta"), b.column("tb")):
                if a != last:
                    last, p = a, true_set(ta.as_py())
                q = true_set(tb.as_py())
                x = np.sort(np.concatenate([p, q]))
                both = int(np.count_nonzero(x[1:] == x[:-1]))
                good.append(100 * both >= percent * (len(x) - both))
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def dedup(docs: DataFrame, percent: int = 80, least: int = 20, carry: bool = False, whole: bool = False) -> DataFrame:
    """One row for each input row: doc_id, n_lines, n_removed, removed (line numbers from 0), kept_text.

    With ``carry`` a struct ``rest`` holds the row's columns other than text.  With ``whole`` all lines
    but blank ones take part, whatever ``least`` is; lines under SHINGLE bytes are linked if equal.

    Lines are linked at ``percent`` Jaccard similarity of their sets of SHINGLE-byte shingles; of the
    lines that links join, the first by (doc_id, line number) stays and all others are removed.
    """
    least = 0 if whole else max(least, SHINGLE)
    chunks = wire.pieces(docs)
    dealt = wire.dealt_table(docs, chunks, carry)

    def sign(chunk: int, ids: np.ndarray, texts: pa.Array) -> pa.Table:
        own = Lines(ids, texts, least).distinct
        a, b = line_digests(own).T
        keys, owners = band_keys(own)
        bucket = ((keys & U(0xFFFFFF)) % U(chunks)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        keys, bucket, owners, v = keys[order], bucket[order], owners[order], keys[order] >> U(24)
        bands = wire.cells(chunk, bucket, (v >> U(8)).astype(np.uint32), (v & U(0xFF)).astype(np.uint8), (a[owners] >> U(32)).astype(np.uint32), wire.narrow(owners))
        bucket = (a % U(chunks)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return pa.concat_tables([bands, wire.cells(chunk, bucket[order] + chunks, a[order], b[order], wire.narrow(order))])

    sent = wire.each_chunk(dealt, sign, wire.CELL)
    met = wire.cut(sent.groupBy("bucket").applyInArrow(meet(chunks), "key long, node long, rep long"))
    buckets, equal = met.filter("key is not null").select("key", "node"), met.filter("rep is not null").select("node", "rep")

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = "node long, doc_id long, line long, text binary"
        if not left.num_rows or not right.num_rows:
            return wire.empty(schema)
        ids, texts = wire.open_chunk(left.column("body"))
        own = Lines(ids, texts, least)
        node = np.asarray(right.column("node"), np.int64)
        at, near = (node & 0xFFFFFFFF).tolist(), right.column("near").to_pylist()
        return pa.table(
            {
                "node": pa.array(node),
                "doc_id": pa.array([int(ids[own.first[x][0]]) for x in at], pa.int64()),
                "line": pa.array([(own.first[x][0] << 32) + own.first[x][1] for x in at], pa.int64()),
                "text": pa.array([own.distinct[x] if n else None for x, n in zip(at, near)], pa.binary()),
            }
        )

    # Texts are wanted of lines in band buckets only, places of all.
    wanted = met.groupBy("node").agg(F.max(F.col("key").isNotNull()).alias("near")).withColumn("chunk", F.shiftright("node", 32).cast("int"))
    texts = wire.cut(dealt.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(look_up, "node long, doc_id long, line long, text binary"))
    body = texts.filter("text is not null").select(F.col("node").alias("n"), "text")

    def verify(pairs: DataFrame) -> DataFrame:
        full = pairs.join(body.withColumnRenamed("text", "tb"), F.col("b") == F.col("n")).drop("n")
        full = graph.looked_up(full, "a", "b", body.withColumnsRenamed({"n": "k_", "text": "ta"}), keys=pairs)
        return full.mapInArrow(exactly(percent), "a long, b long")

    found = graph.settle(buckets, verify, lambda n: n.join(body.withColumnRenamed("n", "m"), F.col("node") == F.col("m")).select("node", "text"), set_list, percent)
    # A line stands for the lines that equal it; a line alone in its component needs no row.
    names = graph.looked_up(equal, "rep", "node", found.withColumnRenamed("node", "k_"), "left").select(F.col("node").alias("e"), F.coalesce("component", "rep").alias("name"))
    names = names.unionByName(found.join(equal, "node", "left_anti").select(F.col("node").alias("e"), F.col("component").alias("name")))
    places = texts.join(names, F.col("node") == F.col("e"), "left").select("node", F.coalesce("name", "node").alias("component"), F.struct("doc_id", "line", "node").alias("place"))
    gone = graph.beside(places, "component", "node", first=F.min("place")).filter("node <> first.node").select("node", F.shiftright("node", 32).cast("int").alias("chunk"))

    schema = docs.sparkSession.createDataFrame([], SCHEMA).schema
    if carry:
        schema = schema.add("rest", docs.drop("text").schema)
    none = to_arrow_schema(schema).empty_table()

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return none
        ids, texts = wire.open_chunk(left.column("body"))
        own = Lines(ids, texts, least)
        dropped = set((np.asarray(right.column("node"), np.int64) & 0xFFFFFFFF).tolist())
        n_lines, removed, kept, seen = [], [], [], set()
        for d, (row, lines) in enumerate(zip(own.which, own.texts)):
            out = []
            for n, c in enumerate(row):
                if c >= 0:
                    if c in dropped or c in seen:
                        out.append(n)
                    seen.add(c)
            gone_here = set(out)
            n_lines.append(len(lines) if own.valid[d] else 0)
            removed.append(out)
            kept.append(b"\n".join(x for n, x in enumerate(lines) if n not in gone_here).decode() if own.valid[d] else None)
        rest = {"rest": wire.chunk_table(left.column("body")).column("rest")} if carry else {}
        return pa.table({"doc_id": pa.array(ids), "n_lines": pa.array(n_lines, pa.int64()), "n_removed": pa.array([len(x) for x in removed], pa.int64()), "removed": pa.array(removed, pa.list_(pa.int32())), "kept_text": pa.array(kept, pa.string())} | rest)

    return dealt.groupBy("chunk").cogroup(gone.groupBy("chunk")).applyInArrow(remove, schema).withColumn("doc_id", wire.real_id())
