"""Language identification by bit-sliced Bloom filters of n-grams.

A gram is four neighbouring bytes of a text in which letters are lower-cased and all else is one
space.  For every language and every level a Bloom filter holds the grams that at least that share
of the language's documents have.  The filters of all languages are stored slice by slice: a slot
holds one bit for each language, so the AND of a gram's slots is the mask of languages that contain
it.  Per-language popcounts over a document, corrected for each filter's false positives, decide.

The model is fitted on a bounded sample: at most about ``PER_LANGUAGE`` labelled documents of each
language, chosen by a hash of the text.  A null lang is never learned.  A text that is null or has no
letter is ``und`` with score 0.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan, wire

U = np.uint64
PER_LANGUAGE = 4000
#: Shares of a language's documents that must have a gram, level by level.
LEVELS = (0.01, 0.05, 0.2)
PROBES = 3
SLOTS_PER_GRAM = 12

FOLD = np.full(256, 32, np.uint8)
FOLD[65:91] = np.arange(97, 123)
FOLD[97:123] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams as 32-bit numbers and their documents; grams with two spaces in a row are left out.

    Two-byte Latin capitals (U+00C0 to U+00DE) are folded to their small letters.
    """
    x = FOLD[data]
    if len(x) > 1:
        cap = np.flatnonzero((x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E)) + 1
        x[cap] += 32
    n = np.diff(offsets)
    # Each document gets a space before and after it.
    padded = np.full(len(x) + 2 * len(n), 32, np.uint8)
    padded[np.arange(len(x)) + np.repeat(2 * np.arange(len(n)) + 1, n)] = x
    off = offsets + 2 * np.arange(len(offsets))
    at = scan.window_starts(off, 4)
    doc = np.repeat(np.arange(len(n)), np.maximum(n + 2 - 3, 0))
    p = padded.astype(np.uint32)
    word = p[:-3] | p[1:-2] << np.uint32(8) | p[2:-1] << np.uint32(16) | p[3:] << np.uint32(24) if len(p) > 3 else p[:0]
    space = padded == 32
    double = space[:-1] & space[1:]
    bad = double[:-2] | double[1:-1] | double[2:] if len(double) > 2 else double[:0]
    good = ~bad[at]
    return word[at][good], doc[good]


def slots(gram: np.ndarray, size: int) -> list[np.ndarray]:
    h = scan.mix(gram.astype(np.uint64) + U(0x1234567))
    low, high = h & U(0xFFFFFFFF), h >> U(32) | U(1)
    return [((low + U(i) * high) & U(size - 1)).astype(np.int64) for i in range(PROBES)]


class Model:
    """Filters of all languages: for each level a table of masks and each language's false-positive rate."""

    def __init__(self, langs: list[str], levels: list[list[np.ndarray]]):
        self.langs = langs
        self.words = -(-len(langs) // 64)
        self.tables, self.wrong = [], []
        for own in levels:
            most = max([len(g) for g in own] + [64])
            size = 1 << int(np.ceil(np.log2(most * SLOTS_PER_GRAM)))
            table = np.zeros((self.words, size), np.uint64)
            wrong = np.zeros(len(langs))
            for k, g in enumerate(own):
                for at in slots(g, size):
                    table[k // 64][at] |= U(1) << U(k % 64)
                wrong[k] = ((table[k // 64] >> U(k % 64) & U(1)).mean()) ** PROBES
            self.tables.append(table)
            self.wrong.append(wrong)

    def shares(self, gram: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Corrected share of each document's grams that each language contains, averaged over levels."""
        total = np.maximum(np.bincount(doc, minlength=n), 1)
        out = np.zeros((n, len(self.langs)))
        for table, wrong in zip(self.tables, self.wrong):
            at = slots(gram, table.shape[1])
            for w in range(self.words):
                mask = table[w][at[0]]
                for a in at[1:]:
                    mask &= table[w][a]
                own = range(64 * w, min(len(self.langs), 64 * w + 64))
                for k in own:
                    pop = np.bincount(doc, (mask >> U(k % 64) & U(1)).astype(np.float64), n)
                    out[:, k] += np.clip((pop / total - wrong[k]) / (1 - wrong[k]), 0, 1)
        return out / len(self.tables)


def has_letter(texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    letter = np.concatenate([[0], np.cumsum((FOLD[data] != 32) & (data < 128))])
    out = letter[offsets[1:]] > letter[offsets[:-1]]
    for d in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[d] = any(c.isalpha() for c in texts[d].as_py())
    return out


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from (text, lang) rows; all else that docs holds is ignored.

    About ``per_language`` distinct texts of each language are read, each once, however often it is repeated.
    """
    rows = docs.filter("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    rows = rows.withColumn("print", F.xxhash64("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.greatest(F.approx_count_distinct("print"), F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], [[] for _ in LEVELS])
    part = F.element_at(F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, per_language / sizes[k])))]), F.col("lang"))
    sample = rows.filter(F.pmod("print", F.lit(1 << 30)) < part * (1 << 30)).groupBy("lang", "print").agg(F.min("text").alias("text"))
    number = {k: i for i, k in enumerate(langs)}

    def count(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: dict[int, list] = {}
        seen: dict[int, int] = {}
        for b in batches:
            data, offsets = scan.column_bytes(b.column("text"))
            lang = np.array([number[x] for x in b.column("lang").to_pylist()], np.int64)
            for i, j, part, off in scan.passes(data, offsets):
                g, d = grams(part, off)
                key = np.unique(d.astype(np.uint64) << U(32) | g)
                own = lang[i:j][(key >> U(32)).astype(np.int64)]
                for k in np.unique(lang[i:j]).tolist():
                    seen[k] = seen.get(k, 0) + int((lang[i:j] == k).sum())
                    v, c = np.unique((key[own == k] & U(0xFFFFFFFF)).astype(np.uint32), return_counts=True)
                    held.setdefault(k, []).append((v, c))
        for k, parts in held.items():
            v, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            c = np.bincount(inverse, np.concatenate([p[1] for p in parts]))
            yield pa.record_batch({"lang": pa.array(np.full(len(v) + 1, k, np.int32)), "gram": pa.array(np.append(v.astype(np.int64), -1)), "n": pa.array(np.append(c, seen[k]).astype(np.int64))})

    counts = sample.mapInArrow(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = wire.cut(counts)
    seen = {r["lang"]: r["n"] for r in counts.filter("gram < 0").collect()}
    # A document has a bounded number of grams, so at most (grams a document) / level of them reach a level.
    least = F.element_at(F.create_map(*[x for k, n in seen.items() for x in (F.lit(k), F.lit(float(max(2, LEVELS[0] * n))))]), F.col("lang"))
    kept = counts.filter((F.col("gram") >= 0) & ((F.col("n") >= least) | (least <= 2))).toPandas() if seen else None
    levels = []
    for level in LEVELS:
        own = []
        for k in range(len(langs)):
            x = kept[kept.lang == k] if kept is not None else None
            own.append(x.gram[x.n >= max(1, level * seen.get(k, 0))].to_numpy().astype(np.uint32) if x is not None else np.zeros(0, np.uint32))
        levels.append(own)
    return Model(langs, levels)


def decide(m: Model, texts: pa.Array) -> Iterable[tuple[int, list[str], np.ndarray, np.ndarray]]:
    """(first row, languages, scores, shares) of passes over texts."""
    data, offsets = scan.column_bytes(texts)
    for i, j, part, off in scan.passes(data, offsets, 1 << 19):
        n = j - i
        known = has_letter(texts.slice(i, n), part, off)
        if m.langs:
            share = m.shares(*grams(part, off), n)
            best = np.argmax(share, 1)
            top, total = share[np.arange(n), best], share.sum(1)
            score = np.where(total > 0, top / np.maximum(total, 1e-12), 1 / len(m.langs))
            names = [m.langs[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist())]
        else:
            top, score, names = np.zeros(n), np.zeros(n), ["und"] * n
        yield i, names, np.where(known, score, 0.0), np.where(known, top, 0.0)


def keep(docs: DataFrame, model: Model, least: float = 0.1) -> DataFrame:
    """The rows, with all their columns, that have a language: not ``und``, and a share of ``least`` or more.

    A text of fewer than 16 characters shows too few grams to be rejected and stays if it has a letter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            short = pc.fill_null(pc.less(pc.utf8_length(texts), 16), True)
            mask = [np.zeros(0, bool)]
            for _, names, _, share in decide(shared.value, texts):
                mask.append((np.array(names, object) != "und") & (share >= least))
                mask[-1] |= np.asarray(short)[sum(map(len, mask[:-1])) :][: len(names)] & (np.array(names, object) != "und")
            yield b.filter(pa.array(np.concatenate(mask)))

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each input row: doc_id, lang_pred, score, share.

    ``share`` is the winning language's corrected share of the grams, ``score`` its part of all
    languages' shares; of ties the first language in alphabetical order wins.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for i, names, score, share in decide(shared.value, b.column("text")):
                yield pa.record_batch({"doc_id": b.column("doc_id").slice(i, len(names)), "lang_pred": pa.array(names, pa.string()), "score": pa.array(score), "share": pa.array(share)})

    return wire.ids_and_texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, share double").withColumn("doc_id", wire.real_id())
