"""Substring dedup by seed and extend: winnowed anchors, extension both ways, maximal repeats.

Seed: in every window of ``length`` words the word k-gram with the smallest fingerprint is its
anchor.  Equal windows have equal anchors, so only windows whose anchor occurs in two documents can
repeat; a first exchange counts anchors from 40 bits each.  Extend: around a shared anchor a chunk cuts
the *context*, the words of all neighbouring windows that have it, and the distinct contexts of an
anchor meet.  There all of them are extended together, word by word to the left and to the right:
contexts that agree so far fall into groups by their next word, of true words, so no pair is ever
formed.  Where both extensions reach ``length`` words, the smallest document of the group is known.
Overlapping repeated windows join into maximal repeats, which are what is removed.

An anchor with more than ``HOT`` contexts is not gathered: each of its windows is a context of its own
and is dealt by all of its words.

A null or empty text has no words.  Rows with a null doc_id count as one document that comes before
all others.  Repeated rows of one doc_id are the same document: neither is removed for the other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan, wire

U = np.uint64
HOT = 100_000
SCHEMA = "doc_id long, n_words long, n_removed long, spans array<int>, kept_text string"


def gram_size(length: int) -> int:
    return max(1, (2 * length) // 5)


def cat(arrays: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(arrays).astype(kind) if arrays else np.zeros(0, kind)


class Part:
    """A pass over texts: its words, and its text with one space between words."""

    def __init__(self, part: np.ndarray, off: np.ndarray):
        self.s, self.e, self.by_doc = scan.words(part, off, scan.SPACES)
        self.raw = part.tobytes()
        n = self.e - self.s
        # Words and one space after each, wherever they were.
        self.ends = np.cumsum(n + 1) - 1
        norm = np.full(int(self.ends[-1]) + 1 if len(n) else 0, 32, np.uint8)
        norm[scan.ranges(self.ends - n, n)] = part[scan.ranges(self.s, n)]
        self.starts, self.norm = self.ends - n, norm.tobytes()
        self.values = scan.Prints(part, 1).at(self.s, self.e)


class Runs:
    """Runs of neighbouring windows of a chunk that have the same anchor, and the distinct anchors by bucket."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, length: int, buckets: int):
        self.ids, self.length, self.buckets = ids, length, buckets
        self.k = gram_size(length)
        self.parts: list[tuple[int, int, Part]] = []
        which, start, count, offset, anchor, doc = [], [], [], [], [], []
        for i, j, part, off in scan.passes(*scan.column_bytes(texts)):
            p = Part(part, off)
            at = scan.window_starts(p.by_doc, length)
            if len(at):
                grams = scan.Prints(p.values, 2).grams(self.k)
                pos = scan.anchors(grams, length - self.k + 1)[at]
                first = np.flatnonzero(np.diff(pos, prepend=-1))
                which.append(np.full(len(first), len(self.parts)))
                start.append(at[first]), offset.append(pos[first] - at[first]), anchor.append(grams[pos[first]])
                count.append(np.diff(np.append(first, len(pos))))
                doc.append(np.searchsorted(p.by_doc, at[first], "right") - 1 + i)
            self.parts.append((i, j, p))
        self.which, self.start, self.count, self.offset, self.doc = (cat(x, np.int64) for x in (which, start, count, offset, doc))
        self.anchor = cat(anchor, np.uint64)
        values, inverse, times = np.unique(self.anchor, return_inverse=True, return_counts=True)
        bucket = ((values & U(0xFFFFFF)) % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.values, self.bucket, self.times, self.of_run = values[order], bucket[order], times[order], place[inverse]
        own = self.ids[self.doc]
        low = np.full(len(values), np.iinfo(np.int64).max)
        np.minimum.at(low, self.of_run, own)
        self.several = np.zeros(len(values), bool)
        self.several[self.of_run[own > low[self.of_run]]] = True

    def cells(self, chunk: int) -> pa.Table:
        v = self.values >> U(24)
        return wire.cells(chunk, self.bucket, (v >> U(8)).astype(np.uint32), (v & U(0xFE)).astype(np.uint8) | self.several, wire.narrow(self.times))


def count_anchors(most: int):
    """For each anchor of each cell two bits: two documents may have it; it is hot."""

    def run(cells: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
        key = np.concatenate([hi.astype(np.uint64) << U(8) | (lo & 0xFE) for hi, lo, _ in cells])
        flag = np.concatenate([lo & 1 for _, lo, _ in cells]).astype(bool)
        _, inverse, holders = np.unique(key, return_inverse=True, return_counts=True)
        some = holders > 1
        some[inverse[flag]] = True
        hot = np.bincount(inverse, np.concatenate([n for _, _, n in cells])) > most
        cuts = np.cumsum([len(hi) for hi, _, _ in cells])[:-1]
        return [[np.packbits(a), np.packbits(b)] for a, b in zip(np.split(some[inverse], cuts), np.split(hot[inverse], cuts))]

    return run


class Contexts:
    """Distinct contexts of a chunk by bucket, each with its smallest document here."""

    def __init__(self, runs: Runs, got: dict[int, bytes]):
        self.runs = runs
        shared, hot = np.zeros(len(runs.values), bool), np.zeros(len(runs.values), bool)
        cuts = np.flatnonzero(np.diff(runs.bucket, prepend=-1))
        for s, e in zip(cuts, [*cuts[1:], len(runs.bucket)]):
            if (body := got.get(int(runs.bucket[s]))) is not None:
                a, b = wire.unpack(body)
                shared[s:e], hot[s:e] = np.unpackbits(a, count=e - s), np.unpackbits(b, count=e - s)
        whole = np.flatnonzero(shared[runs.of_run] & ~hot[runs.of_run])
        split = np.flatnonzero(shared[runs.of_run] & hot[runs.of_run])
        times = runs.count[split]
        shift = scan.ranges(np.zeros(len(split), np.int64), times)
        each = lambda x: np.concatenate([x[whole], np.repeat(x[split], times)])
        self.which, self.doc = each(runs.which), each(runs.doc)
        self.start = np.concatenate([runs.start[whole], np.repeat(runs.start[split], times) + shift])
        self.count = np.concatenate([runs.count[whole], np.ones(len(shift), np.int64)])
        offset = np.concatenate([runs.offset[whole], np.repeat(runs.offset[split], times) - shift])
        key = runs.anchor[whole] & U(0xFFFFFF)
        dealt = np.zeros(len(self.which), np.int64)
        dealt[: len(whole)] = (key % U(runs.buckets)).astype(np.int64)
        known: dict[bytes, int] = {}
        self.of = np.zeros(len(self.which), np.int64)
        for number, (_, _, p) in enumerate(runs.parts):
            own = np.flatnonzero(self.which == number)
            a, b = self.start[own], self.start[own] + self.count[own] + runs.length - 1
            if len(own) and own[-1] >= len(whole):
                hot_own = own[own >= len(whole)]
                s = self.start[hot_own]
                dealt[hot_own] = (scan.Prints(p.values, 3).at(s, s + runs.length) % U(runs.buckets)).astype(np.int64)
            text = p.norm
            self.of[own] = [known.setdefault(text[x:y], len(known)) for x, y in zip(p.starts[a].tolist(), p.ends[b - 1].tolist())]
        first = np.unique(self.of, return_index=True)[1]
        ids = runs.ids[self.doc]
        self.low = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(self.low, self.of, ids)
        self.n, self.offset = self.count[first], offset[first]
        self.order = np.argsort(dealt[first], kind="stable")
        self.bucket, self.texts = dealt[first][self.order], list(known)

    def each_bucket(self):
        cuts = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        for s, e in zip(cuts, [*cuts[1:], len(self.bucket)]):
            yield int(self.bucket[s]), self.order[s:e]

    def cells(self, chunk: int) -> pa.Table:
        rows: dict[str, list] = {"chunk": [], "bucket": [], "body": []}
        for bucket, own in self.each_bucket():
            text = b"\n".join([self.texts[x] for x in own.tolist()])
            body = wire.pack(np.frombuffer(text, np.uint8), wire.narrow(self.offset[own]), self.low[own])
            rows["chunk"].append(chunk), rows["bucket"].append(bucket)
            rows["body"].append(len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True))
        return pa.table({"chunk": pa.array(rows["chunk"], pa.int32()), "bucket": pa.array(rows["bucket"], pa.int32()), "body": pa.array(rows["body"], pa.binary())})

    def repeated(self, got: dict[int, bytes]) -> list[np.ndarray]:
        """For each pass the starts of its repeated windows."""
        base = np.concatenate([[0], np.cumsum(self.n)])
        earlier = np.zeros(base[-1], bool)
        for bucket, own in self.each_bucket():
            n = self.n[own]
            earlier[scan.ranges(base[own], n)] = np.unpackbits(wire.unpack(got[bucket])[0], count=int(n.sum())).astype(bool)
        later = self.runs.ids[self.doc] > self.low[self.of]
        hit = np.repeat(later, self.count) | earlier[scan.ranges(base[self.of], self.count)]
        at, which = scan.ranges(self.start, self.count)[hit], np.repeat(self.which, self.count)[hit]
        return [at[which == number] for number in range(len(self.runs.parts))]


def refine(group: np.ndarray, word: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Groups split by a further word; -1 where there is none."""
    out = np.full(len(group), -1)
    own = np.flatnonzero(alive & (group >= 0))
    if len(own):
        out[own] = np.unique(group[own] * (int(word.max()) + 1) + word[own], return_inverse=True)[1]
    return out


def extend(words: np.ndarray, base: np.ndarray, anchor: np.ndarray, low: np.ndarray, length: int) -> np.ndarray:
    """The smallest document of each window of the contexts, which are words[base[i] : base[i + 1]].

    ``anchor`` is where a context's anchor starts in it.  All contexts are extended at once: groups that
    agree on the anchor are split by the words to its right, one at a time, and by those to its left.
    """
    k = gram_size(length)
    n, start = np.diff(base), base[:-1] + anchor
    top = len(words) - 1
    group = np.zeros(len(n), np.int64)
    for t in range(k):
        group = refine(group, words[np.minimum(start + t, top)], np.ones(len(n), bool))
    right, left = [group], [group]
    for t in range(length - k):
        right.append(refine(right[-1], words[np.minimum(start + k + t, top)], anchor + k + t < n))
        left.append(refine(left[-1], words[np.maximum(start - 1 - t, 0)], anchor - 1 - t >= 0))
    windows = n - length + 1
    place = np.cumsum(windows) - windows
    out = np.empty(int(windows.sum()), np.int64)
    for t in range(length - k + 1):  # t words to the left of the anchor
        a, b = left[t], right[length - k - t]
        own = np.flatnonzero((a >= 0) & (b >= 0))
        if len(own):
            same = np.unique(a[own] * (int(b.max()) + 1) + b[own], return_inverse=True)[1]
            least = np.full(int(same.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, same, low[own])
            out[place[own] + anchor[own] - t] = least[same]
    return out


def earlier_windows(length: int):
    """Bits for each cell: the window occurs in a smaller document than the smallest its chunk has for the context."""

    def run(bodies: list[bytes]) -> list[np.ndarray]:
        known: dict[bytes, int] = {}
        anchor, own, lows = [], [], []
        for body in bodies:
            text, offset, low = wire.unpack(pa.decompress(body[8:], int.from_bytes(body[:8], "little"), "zstd", asbytes=True))
            mine = [known.setdefault(x, len(known)) for x in text.tobytes().split(b"\n")]
            for c, x in zip(mine, offset.tolist()):
                if c == len(anchor):
                    anchor.append(x)
            own.append(np.array(mine, np.int64)), lows.append(low)
        low = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(low, np.concatenate(own), np.concatenate(lows))
        numbers: dict[bytes, int] = {}
        split = [x.split(b" ") for x in known]
        words = np.array([numbers.setdefault(w, len(numbers)) for x in split for w in x], np.int64)
        base = np.concatenate([[0], np.cumsum([len(x) for x in split])]).astype(np.int64)
        least = extend(words, base, np.array(anchor, np.int64), low, length)
        n = np.diff(base) - length + 1
        place = np.cumsum(n) - n
        return [np.packbits(least[scan.ranges(place[c], n[c])] < np.repeat(x, n[c])) for c, x in zip(own, lows)]

    def each(t: pa.Table) -> pa.Table:
        out = run([b.as_py() for b in t.column("body")])
        return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "body": pa.array([wire.pack(x) for x in out], pa.binary())})

    return each


def kept_words(ids: np.ndarray, runs: Runs, starts: list[np.ndarray]) -> pa.Table:
    """Documents without the words of their repeated windows, and the removed runs as [start, end) pairs."""
    n_words, n_removed, spans, kept = [], [], [], []
    for (i, j, p), at in zip(runs.parts, starts):
        hit = scan.covered(len(p.s), at, runs.length)
        sums = np.concatenate([[0], np.cumsum(hit)])
        n_words.append(np.diff(p.by_doc))
        n_removed.append(sums[p.by_doc[1:]] - sums[p.by_doc[:-1]])
        for d in range(j - i):
            lo, hi = p.by_doc[d], p.by_doc[d + 1]
            if n_removed[-1][d]:
                edge = np.diff(np.concatenate([[False], hit[lo:hi], [False]]).astype(np.int8))
                a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                spans.append(np.stack([a, b], 1).ravel().tolist())
                stay = zip(np.append(0, b).tolist(), np.append(a, hi - lo).tolist())
                kept.append(b" ".join([p.norm[p.starts[lo + x] : p.ends[lo + y - 1]] for x, y in stay if y > x]).decode())
            else:
                spans.append([])
                kept.append(p.norm[p.starts[lo] : p.ends[hi - 1]].decode() if hi > lo else "")
    return pa.table({"doc_id": pa.array(ids), "n_words": pa.array(cat(n_words, np.int64)), "n_removed": pa.array(cat(n_removed, np.int64)), "spans": pa.array(spans, pa.list_(pa.int32())), "kept_text": pa.array(kept, pa.string())})


def dedup(docs: DataFrame, length: int = 13, hot: int = HOT) -> DataFrame:
    """Each document without the words covered by a window of ``length`` words that a smaller doc_id also has.

    Returns one row for each input row: doc_id, n_words, n_removed, spans (start, end, start, end, ...
    in words: the maximal repeats) and kept_text (the other words joined by one space).
    """
    parts = wire.pieces(docs)
    dealt = wire.chunked(docs, parts).repartition(parts, "chunk")

    def seeds(chunk: int, ids: np.ndarray, texts: pa.Array) -> pa.Table:
        return Runs(ids, texts, length, parts).cells(chunk)

    def contexts(chunk: int, ids: np.ndarray, texts: pa.Array, got: dict[int, bytes]) -> pa.Table:
        return Contexts(Runs(ids, texts, length, parts), got).cells(chunk)

    def remove(chunk: int, ids: np.ndarray, texts: pa.Array, got: dict[int, bytes]) -> pa.Table:
        runs = Runs(ids, texts, length, parts)
        c = Contexts(runs, {k: v for k, v in got.items() if k < parts})
        return kept_words(ids, runs, c.repeated({k - parts: v for k, v in got.items() if k >= parts}))

    first = wire.each_bucket(wire.each_chunk(dealt, seeds, wire.CELL), count_anchors(hot))
    second = wire.each_chunk_with(dealt, first, contexts, wire.CELL).groupBy("bucket").applyInArrow(earlier_windows(length), wire.CELL)
    answers = first.unionByName(second.withColumn("bucket", F.col("bucket") + F.lit(parts)))
    return wire.each_chunk_with(dealt, answers, remove, SCHEMA).withColumn("doc_id", wire.real_id())
