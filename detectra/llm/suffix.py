"""Suffix-array dedup: maximal repeats of bytes from a common-prefix interval tree.

Suffixes that can share ``length`` bytes share an anchor: of the byte k-grams in those bytes the one
with the smallest fingerprint, the last of ties.  A first exchange counts anchors.  Around an anchor
that occurs twice a chunk cuts its *context*, the bytes of all windows that have this anchor, and a
second exchange brings the distinct contexts of an anchor together.  There an enhanced suffix array
over the suffixes that start a left-diverse group is scanned with a stack: every interval of common
prefix ``length`` or more whose occurrences differ on the left is a maximal repeat, and the interval
is the list of all its occurrences.

An anchor with more than ``HOT`` contexts is not gathered: its windows are dealt one by one by a
128-bit fingerprint, merged within each chunk, and only counted.

Null texts are empty.  Matches never cross documents; a repeat inside one document counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan, wire

U = np.uint64
HOT = 20_000
SCHEMA = "doc_id long, n_bytes long, n_removed long, spans array<int>, kept binary"


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y))


def interval_tree(lcp: list[int], left: list[int], length: int) -> list[tuple[int, int, int]]:
    """Maximal repeats as (first, last, common prefix) of suffix-array positions.

    ``lcp[i]`` belongs to neighbours i - 1 and i.  ``left`` is the byte before a suffix; -1, which
    equals nothing, marks the start of a text.  A stack holds the open intervals with the one left
    byte their suffixes have, or -1 when they differ.
    """
    out: list[tuple[int, int, int]] = []
    join = lambda a, b: a if a == b else -1
    stack = [[0, 0, None]]
    for i in range(1, len(left) + 1):
        here = lcp[i] if i < len(left) else 0
        first, seen = i - 1, left[i - 1]
        while stack[-1][0] > here:
            depth, lb, own = stack.pop()
            own = seen if own is None else join(own, seen)
            if depth >= length and own == -1:
                out.append((lb, i - 1, depth))
            first, seen = lb, own
        if stack[-1][0] < here:
            stack.append([here, first, seen])
        else:
            stack[-1][2] = seen if stack[-1][2] is None else join(stack[-1][2], seen)
    return out


def maximal_repeats(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Suffix array positions of texts, and the maximal repeats of ``length`` bytes or more over it.

    Only suffixes whose first ``length`` bytes recur after unlike bytes can start a maximal repeat;
    fingerprints find those, and the sort and the prefixes compare true bytes.
    """
    starts = scan.window_starts(offsets, length)
    if not len(starts):
        return starts, []
    prints = scan.Prints(data, 9).grams(length)[starts]
    order = np.argsort(prints, kind="stable")
    edge = np.flatnonzero(np.diff(prints[order], prepend=~prints[order[0]]))
    size = np.diff(np.append(edge, len(order)))
    text = np.searchsorted(offsets, starts, "right") - 1
    left = np.where(starts > offsets[text], data[np.maximum(starts - 1, 0)].astype(np.int64), -1)
    by_group = left[order]
    low, high = np.minimum.reduceat(by_group, edge), np.maximum.reduceat(by_group, edge)
    diverse = (size > 1) & ((low < 0) | (low < high))
    members = order[np.repeat(diverse, size)]
    raw = data.tobytes()
    suffix = [raw[s:e] for s, e in zip(starts[members].tolist(), offsets[text[members] + 1].tolist())]
    rank = sorted(range(len(suffix)), key=suffix.__getitem__)
    lcp = [0, *(common_prefix(suffix[a], suffix[b]) for a, b in zip(rank, rank[1:]))]
    members = members[np.array(rank, np.int64)] if rank else members[:0]
    return starts[members], interval_tree(lcp, left[members].tolist(), length)


def repeated_windows(data: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """Whether each window of ``length`` bytes occurs more than once in the texts."""
    starts = scan.window_starts(offsets, length)
    array, groups = maximal_repeats(data, offsets, length)
    reach = np.zeros(len(array), np.int64)
    for lb, rb, depth in sorted(groups, key=lambda g: g[2]):
        reach[lb : rb + 1] = depth - length + 1
    hit = scan.covered(len(data) + 1, array[reach > 0], reach[reach > 0])
    return hit[starts]


class Runs:
    """Runs of neighbouring windows of a chunk that have the same anchor."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, length: int, buckets: int):
        self.ids, self.length, self.buckets = ids, length, buckets
        self.data, self.offsets = scan.column_bytes(texts)
        k = max(1, length // 5)
        start, count, anchor = [], [], []
        for i, _, part, off in scan.passes(self.data, self.offsets):
            at = scan.window_starts(off, length)
            if len(at):
                grams = scan.Prints(part, 1).grams(k)
                pos = scan.anchors(grams, length - k + 1)[at]
                first = np.flatnonzero(np.diff(pos, prepend=-1))
                start.append(at[first] + self.offsets[i])
                count.append(np.diff(np.append(first, len(pos))))
                anchor.append(grams[pos[first]])
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.start, self.count, self.anchor = cat(start, np.int64), cat(count, np.int64), cat(anchor, np.uint64)
        values, inverse, times = np.unique(self.anchor, return_inverse=True, return_counts=True)
        bucket = ((values & U(0xFFFFFF)) % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.values, self.bucket, self.times, self.of_run = values[order], bucket[order], times[order], place[inverse]

    def cells(self, chunk: int) -> pa.Table:
        v = self.values >> U(24)
        return wire.cells(chunk, self.bucket, (v >> U(8)).astype(np.uint32), (v & U(0xFF)).astype(np.uint8), wire.narrow(self.times))


def count_anchors(most: int):
    """For each anchor of each cell two bits: it occurs twice or more; it is hot."""

    def run(cells: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
        key = np.concatenate([hi.astype(np.uint64) << U(8) | lo for hi, lo, _ in cells])
        _, inverse = np.unique(key, return_inverse=True)
        total = np.bincount(inverse, np.concatenate([n for _, _, n in cells]))[inverse]
        cuts = np.cumsum([len(hi) for hi, _, _ in cells])[:-1]
        return [[np.packbits(x > 1), np.packbits(x > most)] for x in np.split(total, cuts)]

    return run


class Contexts:
    """Distinct contexts of a chunk's shared anchors, and distinct windows of its hot ones."""

    def __init__(self, runs: Runs, got: dict[int, bytes]):
        self.runs = runs
        shared, hot = np.zeros(len(runs.values), bool), np.zeros(len(runs.values), bool)
        cuts = np.flatnonzero(np.diff(runs.bucket, prepend=-1))
        for s, e in zip(cuts, [*cuts[1:], len(runs.bucket)]):
            if (body := got.get(int(runs.bucket[s]))) is not None:
                a, b = wire.unpack(body)
                shared[s:e], hot[s:e] = np.unpackbits(a, count=e - s), np.unpackbits(b, count=e - s)
        self.mine = np.flatnonzero(shared[runs.of_run] & ~hot[runs.of_run])
        raw, known = runs.data.tobytes(), {}
        ends = runs.start + runs.count + runs.length - 1
        self.which = np.array([known.setdefault(raw[s:e], len(known)) for s, e in zip(runs.start[self.mine].tolist(), ends[self.mine].tolist())], np.int64)
        first = np.unique(self.which, return_index=True)[1]
        self.several = np.bincount(self.which, minlength=len(known)) > 1
        anchor = runs.anchor[self.mine[first]]
        bucket = ((anchor & U(0xFFFFFF)) % U(runs.buckets)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.bucket, self.anchor, self.contexts = bucket[self.order], anchor[self.order], list(known)
        self.hot = np.flatnonzero(hot[runs.of_run])
        self.hot_windows()

    def hot_windows(self) -> None:
        runs = self.runs
        self.at = np.unique(scan.ranges(runs.start[self.hot], runs.count[self.hot])) if len(self.hot) else np.zeros(0, np.int64)
        a, b = [], []
        for i, j, part, _ in scan.passes(runs.data, runs.offsets):
            lo, hi = np.searchsorted(self.at, [runs.offsets[i], runs.offsets[j]])
            if hi > lo:
                s = self.at[lo:hi] - runs.offsets[i]
                a.append(scan.Prints(part, 3).grams(runs.length)[s])
                b.append(scan.Prints(part, 4).grams(runs.length)[s])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b))
        bucket = (a % U(runs.buckets)).astype(np.int64)
        order = np.lexsort((b, a, bucket))
        a, b, bucket = a[order], b[order], bucket[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.w = (a[new], b[new], bucket[new])
        self.w_several = np.diff(np.append(np.flatnonzero(new), len(a))) > 1
        self.w_of = np.empty(len(a), np.int64)
        self.w_of[order] = np.cumsum(new) - 1

    def cells(self, chunk: int) -> pa.Table:
        rows = {"chunk": [], "bucket": [], "body": []}
        cuts = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        for s, e in zip(cuts, [*cuts[1:], len(self.bucket)]):
            own = [self.contexts[x] for x in self.order[s:e].tolist()]
            body = wire.pack(np.frombuffer(b"".join(own), np.uint8), np.array([len(x) for x in own], np.uint32), self.anchor[s:e], self.several[self.order[s:e]].astype(np.uint8))
            rows["chunk"].append(chunk), rows["bucket"].append(int(self.bucket[s]))
            rows["body"].append(len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True))
        t = pa.table({"chunk": pa.array(rows["chunk"], pa.int32()), "bucket": pa.array(rows["bucket"], pa.int32()), "body": pa.array(rows["body"], pa.binary())})
        a, b, bucket = self.w
        return pa.concat_tables([t, wire.cells(chunk, bucket + self.runs.buckets, a, b, self.w_several.astype(np.uint8))])

    def repeated(self, got: dict[int, bytes]) -> np.ndarray:
        """Starts of all repeated windows."""
        runs = self.runs
        bits: list[np.ndarray | None] = [None] * len(self.contexts)
        n = np.array([len(x) for x in self.contexts], np.int64) - runs.length + 1
        cuts = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        for s, e in zip(cuts, [*cuts[1:], len(self.bucket)]):
            own = self.order[s:e]
            flat = np.unpackbits(wire.unpack(got[int(self.bucket[s])])[0], count=int(n[own].sum()))
            for c, x in zip(own.tolist(), np.split(flat, np.cumsum(n[own])[:-1])):
                bits[c] = x
        starts = [np.zeros(0, np.int64)]
        for r, c in zip(self.mine.tolist(), self.which.tolist()):
            starts.append(runs.start[r] + np.flatnonzero(bits[c]))
        _, _, bucket = self.w
        again = wire.by_cell(bucket, {k - runs.buckets: v for k, v in got.items() if k >= runs.buckets}) | self.w_several
        starts.append(self.at[again[self.w_of]])
        return np.concatenate(starts)


def solve_bucket(length: int, buckets: int):
    def contexts(bodies: list[bytes]) -> list[np.ndarray]:
        cells = [wire.unpack(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True)) for b in bodies]
        known: dict[bytes, int] = {}
        which, times, anchor = [], [], []
        for text, n, a, several in cells:
            raw, ends, own = text.tobytes(), np.cumsum(n.astype(np.int64)).tolist(), []
            for s, e, x, more in zip([0, *ends], ends, a.tolist(), several.tolist()):
                c = known.setdefault(raw[s:e], len(known))
                if c == len(times):
                    times.append(0), anchor.append(x)
                times[c] += 1 + more
                own.append(c)
            which.append(own)
        texts = list(known)
        n = np.array([len(x) for x in texts], np.int64)
        bits = [np.full(m, t > 1) for m, t in zip((n - length + 1).tolist(), times)]
        _, of_anchor, distinct = np.unique(np.array(anchor, np.uint64), return_inverse=True, return_counts=True)
        unlike = np.flatnonzero(distinct[of_anchor] > 1)
        unlike = unlike[np.argsort(of_anchor[unlike], kind="stable")]
        at = 0
        while at < len(unlike):  # whole anchors, about 2 MB at a time
            to = at + int(np.searchsorted(np.cumsum(n[unlike[at:]]), 2 << 20, "right"))
            to = max(to, at + 1)
            while to < len(unlike) and of_anchor[unlike[to]] == of_anchor[unlike[to - 1]]:
                to += 1
            own = unlike[at:to].tolist()
            off = np.concatenate([[0], np.cumsum(n[own])])
            hit = repeated_windows(np.frombuffer(b"".join(texts[c] for c in own), np.uint8), off, length)
            for c, x in zip(own, np.split(hit, np.cumsum(n[own] - length + 1)[:-1])):
                bits[c] = bits[c] | x
            at = to
        return [np.packbits(np.concatenate([bits[c] for c in own])) for own in which]

    def windows(bodies: list[bytes]) -> list[np.ndarray]:
        cells = [wire.unpack(b) for b in bodies]
        a, b = (np.concatenate([c[i] for c in cells]) for i in (0, 1))
        order = np.lexsort((b, a))
        new = np.ones(len(a), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        times = np.diff(np.append(np.flatnonzero(new), len(a)))
        again = np.empty(len(a), bool)
        again[order] = (times > 1)[np.cumsum(new) - 1]
        return [np.packbits(x) for x in np.split(again, np.cumsum([len(c[0]) for c in cells])[:-1])]

    def run(t: pa.Table) -> pa.Table:
        bodies = [b.as_py() for b in t.column("body")]
        out = (contexts if t.column("bucket")[0].as_py() < buckets else windows)(bodies)
        return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "body": pa.array([wire.pack(x) for x in out], pa.binary())})

    return run


def dedup(docs: DataFrame, length: int = 200, hot: int = HOT) -> DataFrame:
    """Each document without the bytes covered by a string of ``length`` bytes that also starts elsewhere.

    Returns one row for each input row: doc_id, n_bytes, n_removed, spans (start, end, ... of the
    maximal removed runs, in bytes) and kept (the remaining bytes, which may cut a character).
    """
    parts = wire.pieces(docs)
    dealt = wire.chunked(docs, parts).repartition(parts, "chunk")

    def seeds(chunk: int, ids: np.ndarray, texts: pa.Array) -> pa.Table:
        return Runs(ids, texts, length, parts).cells(chunk)

    first = wire.each_bucket(wire.each_chunk(dealt, seeds, wire.CELL), count_anchors(hot))

    def contexts(chunk: int, ids: np.ndarray, texts: pa.Array, got: dict[int, bytes]) -> pa.Table:
        return Contexts(Runs(ids, texts, length, parts), got).cells(chunk)

    second = wire.each_chunk_with(dealt, first, contexts, wire.CELL).groupBy("bucket").applyInArrow(solve_bucket(length, parts), wire.CELL)

    def remove(chunk: int, ids: np.ndarray, texts: pa.Array, got: dict[int, bytes]) -> pa.Table:
        runs = Runs(ids, texts, length, parts)
        c = Contexts(runs, {k: v for k, v in got.items() if k < parts})
        starts = c.repeated({k - parts: v for k, v in got.items() if k >= parts})
        hit = scan.covered(len(runs.data), starts, length)
        off = runs.offsets
        sums = np.concatenate([[0], np.cumsum(hit)])
        n_removed = sums[off[1:]] - sums[off[:-1]]
        spans, kept, raw = [], [], runs.data.tobytes()
        for d, gone in enumerate(n_removed.tolist()):
            s, e = off[d], off[d + 1]
            if gone:
                edge = np.diff(np.concatenate([[False], hit[s:e], [False]]).astype(np.int8))
                spans.append(np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).ravel().tolist())
                kept.append(runs.data[s:e][~hit[s:e]].tobytes())
            else:
                spans.append([])
                kept.append(raw[s:e])
        return pa.table({"doc_id": pa.array(ids), "n_bytes": pa.array(np.diff(off)), "n_removed": pa.array(n_removed.astype(np.int64)), "spans": pa.array(spans, pa.list_(pa.int32())), "kept": pa.array(kept, pa.binary())})

    answers = first.unionByName(second.withColumn("bucket", F.col("bucket") + F.lit(parts)))
    return wire.each_chunk_with(dealt, answers, remove, SCHEMA).withColumn("doc_id", wire.real_id())
