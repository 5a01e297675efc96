"""Benchmark decontamination: a broadcast hash set of normalised n-grams, verified hits, removal.

Words are runs of a-z, digits and non-ASCII characters after lower-casing A-Z.  A window is ``n``
neighbouring words of a benchmark item; an item of fewer words, but not none, is one window.  A
document word inside any occurrence of a window is hit.

The window set is broadcast as flat arrays while its built size, which is known beforehand, is at most
``BROADCAST_BYTES``; beyond that documents and items send windows to buckets and no side is broadcast.
Both ways compare a fingerprint hit word by word and decide row by row, so they give the same rows.

A null or empty text has no words, is never hit and hits nothing.  Items with one id count once;
items with a null id are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import scan, wire

U = np.uint64
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 64 << 20
#: Bytes of the built set for each window, besides its item's text.
WINDOW_BYTES = 8 + 4 * 4
FILTER = 1 << 20
SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<int>"


class Words:
    """The words of a pass over texts, with fingerprints of their windows."""

    def __init__(self, part: np.ndarray, off: np.ndarray):
        self.s, self.e, self.by_doc = scan.words(part, off, scan.NON_ALNUM)
        self.prints = scan.Prints(scan.Prints(part, 31).at(self.s, self.e), 33)
        self.raw = part.tobytes()

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and fingerprints of all windows of so many words."""
        at = scan.window_starts(self.by_doc, length)
        return at, self.prints.at(at, at + length)

    def text(self, at: int, length: int) -> bytes:
        return b" ".join([self.raw[a:b] for a, b in zip(self.s[at : at + length].tolist(), self.e[at : at + length].tolist())])


def passes(texts: pa.Array) -> Iterator[tuple[int, int, Words]]:
    data, offsets = scan.column_bytes(texts)
    data = scan.LOWER[data]
    for i, j, part, off in scan.passes(data, offsets):
        yield i, j, Words(part, off)


def item_windows(texts: pa.Array, n: int) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray, int]]:
    """For each item with words: its number, its words joined by a space, starts and ends of its windows there, their fingerprints and length."""
    for i, j, w in passes(texts):
        for d in range(j - i):
            lo, hi = int(w.by_doc[d]), int(w.by_doc[d + 1])
            length = min(n, hi - lo)
            if length:
                at = np.arange(lo, hi - length + 1)
                ends = np.cumsum(w.e[lo:hi] - w.s[lo:hi] + 1) - 1
                starts = np.concatenate([[0], ends[:-1] + 1])
                yield i + d, w.text(lo, hi - lo), starts[: len(at)], ends[length - 1 :], w.prints.at(at, at + length), length


class WindowSet:
    """Distinct windows in order of their fingerprints: where their words are in ``text``, and their items."""

    def __init__(self, texts: pa.Array, names: list[str], n: int):
        blob, starts, ends, prints, items, size = [], [], [], [], [], 0
        lengths = set()
        for item, text, s, e, p, length in item_windows(texts, n):
            blob.append(text)
            starts.append(s + size), ends.append(e + size), prints.append(p), items.append(np.full(len(p), item))
            size += len(text)
            lengths.add(length)
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        self.text, self.names, self.lengths = b"".join(blob), names, sorted(lengths)
        s, e, p, item = cat(starts, np.uint32), cat(ends, np.uint32), cat(prints, np.uint64), cat(items, np.uint32)
        order = np.argsort(p, kind="stable")
        s, e, p, item = s[order], e[order], p[order], item[order]
        new = np.ones(len(p), bool)
        new[1:] = p[1:] != p[:-1]
        for x in np.flatnonzero(~new).tolist():  # equal fingerprints of unlike words would be windows of their own
            new[x] = self.text[s[x] : e[x]] != self.text[s[x - 1] : e[x - 1]]
        first = np.flatnonzero(new)
        self.start, self.end, self.prints = s[first], e[first], p[first]
        self.of, self.items = np.append(first, len(p)).astype(np.uint32), item

    def found(self, print_: int, text: bytes) -> list[int]:
        """Item numbers of a window of these words."""
        x = int(np.searchsorted(self.prints, U(print_)))
        out: list[int] = []
        while x < len(self.prints) and self.prints[x] == print_:
            if self.text[self.start[x] : self.end[x]] == text:
                out += self.items[self.of[x] : self.of[x + 1]].tolist()
            x += 1
        return out


def spans_of(hit: np.ndarray) -> list[int]:
    edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)) if len(hit) else np.zeros(0, np.int8)
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).ravel().tolist()


class Hits:
    """Hit words and items of the documents of a batch."""

    def __init__(self, n_words: np.ndarray):
        self.n_words = n_words.astype(np.int64)
        self.hit: dict[int, np.ndarray] = {}
        self.items: dict[int, set[str]] = {}

    def add(self, doc: int, at: int, length: int, names: Iterable[str]) -> None:
        self.hit.setdefault(doc, np.zeros(self.n_words[doc], bool))[at : at + length] = True
        self.items.setdefault(doc, set()).update(names)

    def clean(self) -> np.ndarray:
        out = np.ones(len(self.n_words), bool)
        out[list(self.hit)] = False
        return out

    def table(self, ids: np.ndarray) -> pa.Table:
        none = np.zeros(0, bool)
        hits = [self.hit.get(d, none) for d in range(len(ids))]
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(self.n_words), "n_hit": pa.array([int(h.sum()) for h in hits], pa.int64()), "items": pa.array([sorted(self.items.get(d, ())) for d in range(len(ids))], pa.list_(pa.string())), "spans": pa.array([spans_of(h) for h in hits], pa.list_(pa.int32()))})


def scan_with(known: WindowSet, texts: pa.Array) -> Hits:
    mask = np.zeros(FILTER, bool)
    mask[(known.prints >> U(44)).astype(np.int64)] = True
    out, counts = [], [np.zeros(0, np.int64)]
    for i, _, w in passes(texts):
        counts.append(np.diff(w.by_doc))
        for length in known.lengths:
            at, p = w.windows(length)
            some = np.flatnonzero(mask[(p >> U(44)).astype(np.int64)])
            near = np.minimum(np.searchsorted(known.prints, p[some]), len(known.prints) - 1)
            some = some[known.prints[near] == p[some]]
            doc = np.searchsorted(w.by_doc, at[some], "right") - 1
            for x, q, d in zip(at[some].tolist(), p[some].tolist(), doc.tolist()):
                if items := known.found(q, w.text(x, length)):
                    out.append((i + d, x - int(w.by_doc[d]), length, {known.names[k] for k in items}))
    hits = Hits(np.concatenate(counts))
    for x in out:
        hits.add(*x)
    return hits


def broadcast_set(docs: DataFrame, items: DataFrame, n: int):
    rows = items.collect()
    return docs.sparkSession.sparkContext.broadcast(WindowSet(pa.array([r["text"] for r in rows], pa.string()), [r["item_id"] for r in rows], n))


def broadcast_hits(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    shared = broadcast_set(docs, items, n)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            yield from scan_with(shared.value, b.column("text")).table(np.asarray(b.column("doc_id"), np.int64)).to_batches()

    return wire.ids_and_texts(docs).mapInArrow(run, SCHEMA)


class ChunkWindows:
    """Distinct fingerprints of a chunk's windows by bucket, with all their places."""

    def __init__(self, texts: pa.Array, lengths: list[int], buckets: int):
        self.words, prints, at, doc, size, which, counts = [], [], [], [], [], [], [np.zeros(0, np.int64)]
        for k, (i, _, w) in enumerate(passes(texts)):
            self.words.append((i, w))
            counts.append(np.diff(w.by_doc))
            for length in lengths:
                x, p = w.windows(length)
                prints.append(p), at.append(x), size.append(np.full(len(x), length, np.uint32)), which.append(np.full(len(x), k, np.uint32))
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        p, at, size, which = cat(prints, np.uint64), cat(at, np.int64), cat(size, np.uint32), cat(which, np.uint32)
        bucket = (p % U(buckets)).astype(np.int64)
        order = np.lexsort((p, bucket))
        p, bucket = p[order], bucket[order]
        new = np.ones(len(p), bool)
        new[1:] = p[1:] != p[:-1]
        self.first = np.append(np.flatnonzero(new), len(p))
        self.prints, self.bucket, self.at, self.size, self.which = p[new], bucket[new], at[order], size[order], which[order]
        self.hits = Hits(np.concatenate(counts))

    def mark(self, got: dict[int, bytes]) -> Hits:
        cuts = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        where = dict(zip(self.bucket[cuts].tolist(), cuts.tolist()))
        for b, body in got.items():
            t = wire.unseal(body)
            for x, text, names in zip(t.column("at").to_pylist(), t.column("text").to_pylist(), t.column("items").to_pylist()):
                lo, hi = self.first[where[b] + x : where[b] + x + 2]
                for y in range(lo, hi):
                    i, w = self.words[self.which[y]]
                    at, length = int(self.at[y]), int(self.size[y])
                    if w.text(at, length) == text:
                        d = int(np.searchsorted(w.by_doc, at, "right")) - 1
                        self.hits.add(i + d, at - int(w.by_doc[d]), length, names)
        return self.hits


def exchanged_hits(docs: DataFrame, items: DataFrame, n: int, clean: bool = False) -> DataFrame:
    """The same for a benchmark of any size: windows meet in buckets.  With ``clean``, the clean rows themselves."""
    chunks = wire.pieces(docs)
    dealt = wire.chunked(docs, chunks, clean).repartition(chunks, "chunk")
    lengths = sorted(r[0] for r in items.select(F.least(F.regexp_count("text", F.lit(WORD)), F.lit(n))).distinct().collect() if r[0])

    def send(chunk: int, ids: np.ndarray, texts: pa.Array) -> pa.Table:
        w = ChunkWindows(texts, lengths, chunks)
        return wire.cells(chunk, w.bucket, w.prints)

    def send_items(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("item_id").to_pylist()
            rows: dict[int, list] = {}
            for item, text, s, e, prints, _ in item_windows(batch.column("text"), n):
                for p, a, b in zip(prints.tolist(), s.tolist(), e.tolist()):
                    rows.setdefault(p % chunks, []).append((p, text[a:b], names[item]))
            for bucket, own in rows.items():
                p, text, name = zip(*own)
                body = wire.seal(pa.table({"print": pa.array(p, pa.uint64()), "text": pa.array(text, pa.binary()), "item": pa.array(name, pa.string())}))
                yield pa.record_batch({"chunk": pa.array([-1], pa.int32()), "bucket": pa.array([bucket], pa.int32()), "body": pa.array([body], pa.binary())})

    def meet(t: pa.Table) -> pa.Table:
        known: dict[int, dict[bytes, set[str]]] = {}
        cells = list(zip(t.column("chunk").to_pylist(), t.column("bucket").to_pylist(), t.column("body").to_pylist()))
        for chunk, _, body in cells:
            if chunk < 0:
                own = wire.unseal(body)
                for p, text, item in zip(own.column("print").to_pylist(), own.column("text").to_pylist(), own.column("item").to_pylist()):
                    known.setdefault(p, {}).setdefault(text, set()).add(item)
        prints = np.array(sorted(known), np.uint64)
        out: dict[str, list] = {"chunk": [], "bucket": [], "body": []}
        for chunk, bucket, body in cells if len(prints) else []:
            if chunk >= 0:
                p = wire.unpack(body)[0]
                hits = [(x, text, sorted(own)) for x in np.flatnonzero(np.isin(p, prints)).tolist() for text, own in known[int(p[x])].items()]
                if hits:
                    at, text, own = zip(*hits)
                    out["chunk"].append(chunk), out["bucket"].append(bucket)
                    out["body"].append(wire.seal(pa.table({"at": pa.array(at, pa.int64()), "text": pa.array(text, pa.binary()), "items": pa.array(own, pa.list_(pa.string()))})))
        return pa.table({"chunk": pa.array(out["chunk"], pa.int32()), "bucket": pa.array(out["bucket"], pa.int32()), "body": pa.array(out["body"], pa.binary())})

    rest = docs.drop("text").schema
    schema = StructType().add("text", "string").add("rest", rest) if clean else StructType.fromDDL(SCHEMA)
    none = to_arrow_schema(schema).empty_table()

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return none
        got = dict(zip(right.column("bucket").to_pylist(), right.column("body").to_pylist()))
        ids, texts = wire.open_chunk(left.column("body"))
        hits = ChunkWindows(texts, lengths, chunks).mark(got)
        if not clean:
            return hits.table(ids)
        return wire.chunk_table(left.column("body")).select(["text", "rest"]).filter(pa.array(hits.clean()))

    sent = wire.each_chunk(dealt, send, wire.CELL).unionByName(items.mapInArrow(send_items, wire.CELL))
    answers = sent.groupBy("bucket").applyInArrow(meet, wire.CELL)
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(mark, schema)


def items_of(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The items, and the bytes of their window set as it would be broadcast."""
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    built = F.octet_length("text") + F.octet_length("item_id") + F.lit(WINDOW_BYTES) * F.regexp_count("text", F.lit(WORD))
    return items, items.agg(F.sum(built)).first()[0] or 0


def find(docs: DataFrame, benchmark: DataFrame, n: int = 10, most: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each input row: doc_id, n_words, n_hit, items (ids as sorted strings), spans (runs of hit words).

    ``most`` bounds the bytes of the broadcast set.
    """
    items, size = items_of(benchmark)
    found = broadcast_hits(docs, items, n) if size <= most else exchanged_hits(docs, items, n)
    return found.withColumn("doc_id", wire.real_id())


def keep(docs: DataFrame, benchmark: DataFrame, n: int = 10, most: int = BROADCAST_BYTES) -> DataFrame:
    """The rows, with all their columns, in which no benchmark window occurs."""
    items, size = items_of(benchmark)
    if size > most:
        out = exchanged_hits(docs, items, n, clean=True)
        return out.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
    shared = broadcast_set(docs, items, n)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scan_with(shared.value, b.column("text")).clean()))

    return docs.mapInArrow(run, docs.schema)
