"""Masked pseudo-likelihood scores from a bidirectional window network trained in numpy.

Every token is predicted from ``SIDE`` tokens on either side, by a softmax in two steps: over groups of
``GROUP`` symbols, and within the token's group.  Tokens are lower-cased words; the
``FREQUENT`` commonest words of the whole corpus are tokens of their own and all others fall into
classes by a hash, ``CLASSES`` of them in a small corpus and twice as many for each four times the
distinct words.  A word's probability is that of its class, by the network, times its share of all
words of that class, from counts of every word of the corpus that meet in buckets.

Documents are dealt into chunks by their id and turned into token numbers once.  Training is
data-parallel over chunks: in each round every chunk starts from the same weights, passes over its
windows of the round in an order drawn from (round, chunk), and sends its weights, which are averaged by
the tokens they saw in a tree of sums of ``FAN`` each.  The rounds' windows are disjoint and together
all windows.  So scores depend on the documents and the number of chunks alone, not on partitions
or machines; what is gathered grows with the corpus, while what one task or the driver holds does not.

A document's score is the sum of its tokens' conditional log-probabilities.  A null text or one
without words has no tokens, score 0 and a null mean.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan, wire

U = np.uint64
SIDE, WIDTH, HIDDEN = 2, 16, 32
FREQUENT, CLASSES = 191, 64
VOCAB = 1 + FREQUENT + CLASSES  # 0 stands outside of a document; the symbols of a small corpus
GROUP = 32
ROUNDS, STEP, BATCH = 3, 4e-3, 1024
SHARE = 1 / ROUNDS
FAN = 64
SCHEMA = "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double"


def shapes(vocab: int = VOCAB) -> dict[str, tuple[int, ...]]:
    """Of the weights; the last row of ``hidden``, ``groups`` and each group's ``within`` is the bias."""
    return {"embed": (vocab, WIDTH), "hidden": (2 * SIDE * WIDTH + 1, HIDDEN), "groups": (HIDDEN + 1, vocab // GROUP), "within": (vocab // GROUP, HIDDEN + 1, GROUP)}


def classes_for(distinct: int) -> int:
    return CLASSES << max(0, (distinct.bit_length() - 17) // 2)


def word_prints(part: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    part = scan.LOWER[part]
    s, e, by_doc = scan.words(part, off, scan.SPACES)
    return scan.Prints(part, 41).at(s, e), by_doc


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): fingerprints and counts of all words over all texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            v, inverse = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            return v, np.bincount(inverse, np.concatenate([x[1] for x in held])).astype(np.int64)

        for b in batches:
            data, offsets = scan.column_bytes(b.column("text"))
            for _, _, part, off in scan.passes(data, offsets):
                held.append(np.unique(word_prints(part, off)[0], return_counts=True))
                size += len(held[-1][0])
                if size > 1 << 21:
                    held = [merged()]
                    size = 0
        if held:
            v, n = merged()
            yield from pa.table({"word": pa.array(v.view(np.int64)), "n": pa.array(n)}).to_batches(1 << 16)

    return wire.ids_and_texts(docs).select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The frequent words, the commonest first, and classes of all others with their numbers of words."""

    def __init__(self, words: np.ndarray, classes: int = CLASSES, sizes: np.ndarray | None = None):
        self.order = np.argsort(words)
        self.words = words[self.order]
        self.classes, self.sizes = classes, sizes

    @property
    def symbols(self) -> int:
        return 1 + FREQUENT + self.classes

    def tokens(self, prints: np.ndarray) -> np.ndarray:
        other = 1 + FREQUENT + (prints & U(self.classes - 1)).astype(np.int64)
        if not len(self.words):
            return other
        at = np.minimum(np.searchsorted(self.words, prints), len(self.words) - 1)
        return np.where(self.words[at] == prints, 1 + self.order[at], other)


def vocabulary_of(docs: DataFrame) -> Vocabulary:
    counts = wire.cut(word_counts(docs))
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    classes = classes_for(counts.count())
    sizes = np.zeros(classes)
    for c, n in counts.groupBy(F.col("word").bitwiseAND(F.lit(classes - 1)).alias("c")).agg(F.sum("n")).collect():
        sizes[c] = n
    for r in top:
        sizes[r["word"] & (classes - 1)] -= r["n"]
    return Vocabulary(np.array([r["word"] for r in top], np.int64).view(np.uint64), classes, sizes)


def windows(tokens: np.ndarray, by_doc: np.ndarray) -> np.ndarray:
    """For each token the SIDE tokens before and after it; 0 outside of its document."""
    n = np.diff(by_doc)
    padded = np.zeros(len(tokens) + SIDE * (len(n) + 1), np.int64)
    at = np.arange(len(tokens)) + SIDE * (np.repeat(np.arange(len(n)), n) + 1)
    padded[at] = tokens
    return np.stack([padded[at + d] for d in range(-SIDE, SIDE + 1) if d], 1)


def taught(by_doc: np.ndarray, r: int, rounds: int, share: float) -> np.ndarray:
    """The windows of round r: of ``rounds`` rounds each window has the same number, at least one.

    They follow from a token's place and its document's length, so any partitioning and any retry agree.
    """
    n = np.diff(by_doc)
    place = np.arange(by_doc[-1]) - np.repeat(by_doc[:-1] - n, n)
    return np.flatnonzero((place + r) % rounds < max(1, round(share * rounds)))


def start_weights(seed: int = 3, vocab: int = VOCAB) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    w = {k: r.normal(0, 0.1 if k == "embed" else HIDDEN**-0.5, s).astype(np.float32) for k, s in shapes(vocab).items()}
    w["hidden"][-1], w["groups"][-1], w["within"][:, -1] = 0, 0, 0
    return w


def exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(z - shift) in place of z; its sums by row, and the shift, which is only made where it is needed."""
    shift = np.zeros(len(z), z.dtype)
    if len(z) and (z.max() > 60 or z.min() < -60):
        shift = z.max(1)
        z -= shift[:, None]
    np.exp(z, out=z)
    return z @ np.ones(z.shape[1], z.dtype), shift


class Pass:
    """A batch through the network: inputs and hidden units, each with a last column of ones, and both softmax steps.

    The second step's rows are in order of the tokens' groups.
    """

    def __init__(self, w: dict[str, np.ndarray], around: np.ndarray, tokens: np.ndarray):
        n, kind = len(around), w["embed"].dtype
        self.x, self.h = np.ones((n, len(w["hidden"])), kind), np.ones((n, HIDDEN + 1), kind)
        self.x[:, :-1] = w["embed"][around].reshape(n, -1)
        np.tanh(self.x @ w["hidden"], out=self.h[:, :-1])
        self.group, row = tokens // GROUP, np.arange(n)
        self.order = np.argsort(self.group, kind="stable")
        ends = np.cumsum(np.bincount(self.group, minlength=len(w["within"]))).tolist()
        self.parts = [(g, a, b) for g, a, b in zip(range(len(ends)), [0, *ends], ends) if b > a]
        self.sorted, self.place = self.h[self.order], tokens[self.order] % GROUP
        self.p, self.q = self.h @ w["groups"], np.empty((n, GROUP), kind)
        for g, a, b in self.parts:
            np.matmul(self.sorted[a:b], w["within"][g], out=self.q[a:b])
        self.log_p, own = self.p[row, self.group], self.q[row, self.place]
        self.p_sum, shift = exponentials(self.p)
        self.log_p -= shift + np.log(self.p_sum)
        self.q_sum, shift = exponentials(self.q)
        self.log_p[self.order] += own - shift - np.log(self.q_sum)


def log_probabilities(w: dict[str, np.ndarray], around: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return Pass(w, around, tokens).log_p


def gradients(w: dict[str, np.ndarray], around: np.ndarray, tokens: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean negative log-probability."""
    f, n = Pass(w, around, tokens), len(tokens)
    row, p, q = np.arange(n), f.p, f.q
    p[row, f.group] -= f.p_sum
    p *= (1 / (n * f.p_sum))[:, None]
    q[row, f.place] -= f.q_sum
    q *= (1 / (n * f.q_sum))[:, None]
    within, dh, back = np.zeros_like(w["within"]), p @ w["groups"][:-1].T, np.empty((n, HIDDEN), p.dtype)
    for g, a, b in f.parts:
        np.matmul(f.sorted[a:b].T, q[a:b], out=within[g])
        np.matmul(q[a:b], w["within"][g, :-1].T, out=back[a:b])
    dh[f.order] += back
    own = f.h[:, :-1]
    dh *= 1 - own * own
    embed = np.zeros(w["embed"].size)
    for side in range(0, 2 * SIDE, SIDE):  # in parts, so that no temporary is large
        at = around[:, side : side + SIDE, None] * WIDTH + np.arange(WIDTH)
        embed += np.bincount(at.ravel(), (dh @ w["hidden"][side * WIDTH : (side + SIDE) * WIDTH].T).ravel(), len(embed))
    embed = embed.reshape(-1, WIDTH).astype(w["embed"].dtype)
    return {"embed": embed, "hidden": f.x.T @ dh, "groups": f.h.T @ p, "within": within}


class Adam:
    def __init__(self, w: dict[str, np.ndarray]):
        self.x = flat(w)
        self.w = shaped(self.x, len(w["embed"]))
        self.m, self.v, self.t = np.zeros_like(self.x), np.zeros_like(self.x), 0

    def step(self, around: np.ndarray, tokens: np.ndarray) -> None:
        self.t += 1
        g = flat(gradients(self.w, around, tokens))
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        self.x -= STEP / (1 - 0.9**self.t) * self.m / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in shapes()])


def shaped(x: np.ndarray, vocab: int = VOCAB) -> dict[str, np.ndarray]:
    """The weights as views of one vector."""
    out, at = {}, 0
    for k, s in shapes(vocab).items():
        n = int(np.prod(s))
        out[k] = x[at : at + n].reshape(s)
        at += n
    return out


class Chunk:
    """A chunk's documents as numbers: ids, words of each, tokens, and which rare word each rare token is."""

    def __init__(self, body: bytes):
        self.ids, n, self.tokens, self.rare, self.words = wire.unpack(pa.decompress(body[8:], int.from_bytes(body[:8], "little"), "zstd", asbytes=True))
        self.tokens = self.tokens.astype(np.int64)
        self.by_doc = np.concatenate([[0], np.cumsum(n.astype(np.int64))])

    def by_bucket(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Rare words in order of their buckets, and the buckets."""
        bucket = (scan.mix(self.words) % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return order, bucket[order]


def numbered(dealt: DataFrame, vocabulary) -> DataFrame:
    """(chunk, body) of chunks of texts as Chunk reads them."""

    def run(chunk: int, ids: np.ndarray, texts: pa.Array) -> pa.Table:
        prints, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, part, off in scan.passes(*scan.column_bytes(texts)):
            p, by_doc = word_prints(part, off)
            prints.append(p), n.append(np.diff(by_doc))
        prints = np.concatenate(prints)
        tokens = vocabulary.value.tokens(prints)
        words, rare = np.unique(prints[tokens > FREQUENT], return_inverse=True)
        body = wire.pack(ids, wire.narrow(np.concatenate(n)), wire.narrow(tokens), wire.narrow(rare), words)
        return pa.table({"chunk": pa.array([chunk], pa.int32()), "body": pa.array([len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)], pa.binary())})

    return wire.each_chunk(dealt, run, wire.BODIES)


SUMS = "place int, seen long, body binary"


def train(numbers: DataFrame, chunks: int, symbols: int, rounds: int = ROUNDS, share: float = SHARE) -> dict[str, np.ndarray]:
    """The weights after all rounds over a table of numbered chunks."""
    w = start_weights(vocab=symbols)
    for r in range(rounds):
        shared = numbers.sparkSession.sparkContext.broadcast(w)

        def learn(batches: Iterable[pa.RecordBatch], r: int = r, shared=shared) -> Iterable[pa.RecordBatch]:
            for b in batches:
                for chunk, body in zip(b.column("chunk").to_pylist(), b.column("body")):
                    c = Chunk(body.as_py())
                    own, pick = Adam(shared.value), taught(c.by_doc, r, rounds, share)
                    around = windows(c.tokens, c.by_doc)
                    np.random.default_rng([r, chunk]).shuffle(pick)
                    for s in range(0, len(pick), BATCH):
                        own.step(around[pick[s : s + BATCH]], c.tokens[pick[s : s + BATCH]])
                    if len(pick):
                        yield pa.record_batch({"place": pa.array([chunk], pa.int32()), "seen": pa.array([len(pick)], pa.int64()), "body": pa.array([(own.x.astype(np.float64) * len(pick)).tobytes()], pa.binary())})

        def add(t: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_buffer()) for x in t.sort_by("place").column("body"))
            return pa.table({"place": pa.array([t.column("place")[0].as_py() // FAN], pa.int32()), "seen": pa.array([sum(t.column("seen").to_pylist())], pa.int64()), "body": pa.array([total.tobytes()], pa.binary())})

        sums, left = numbers.mapInArrow(learn, SUMS), chunks
        while left > 1:
            sums, left = sums.groupBy((F.col("place") / FAN).cast("int").alias("up")).applyInArrow(add, SUMS), -(-left // FAN)
        rows = sums.collect()
        if not rows:
            break
        w = shaped((np.frombuffer(rows[0]["body"]) / rows[0]["seen"]).astype(np.float32), symbols)
    return w


def score(docs: DataFrame, rounds: int = ROUNDS, share: float = SHARE) -> DataFrame:
    """One row for each input row: doc_id, n_tokens, log_likelihood, mean_log_likelihood.

    ``share`` of all windows of the corpus train the network in each of ``rounds`` rounds, and every
    window does in at least one.
    """
    return fitted(docs, rounds, share)[0]


def fitted(docs: DataFrame, rounds: int = ROUNDS, share: float = SHARE) -> tuple[DataFrame, Vocabulary, dict[str, np.ndarray]]:
    """The scores, the vocabulary and the network's weights."""
    context = docs.sparkSession.sparkContext
    chunks = wire.pieces(docs)
    vocabulary = vocabulary_of(docs)
    numbers = wire.cut(numbered(wire.chunked(docs, chunks).repartition(chunks, "chunk"), context.broadcast(vocabulary)))
    w = train(numbers, chunks, vocabulary.symbols, rounds, share)
    shared = context.broadcast((vocabulary, w))

    def send(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for chunk, body in zip(b.column("chunk").to_pylist(), b.column("body")):
                c = Chunk(body.as_py())
                order, bucket = c.by_bucket(chunks)
                n = np.bincount(c.rare, minlength=len(c.words))
                yield from wire.cells(chunk, bucket, c.words[order], wire.narrow(n[order])).to_batches()

    def add(cells: list[list[np.ndarray]]) -> list[np.ndarray]:
        v, inverse = np.unique(np.concatenate([x[0] for x in cells]), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([x[1] for x in cells]), len(v)).astype(np.int64)[inverse]
        return [wire.narrow(x) for x in np.split(total, np.cumsum([len(x[0]) for x in cells])[:-1])]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        vocabulary, w = shared.value
        if not left.num_rows:
            return wire.empty(SCHEMA)
        got = dict(zip(right.column("bucket").to_pylist(), right.column("body").to_pylist()))
        c = Chunk(left.column("body")[0].as_py())
        order, bucket = c.by_bucket(chunks)
        part = np.zeros(len(order))
        part[order] = np.concatenate([np.zeros(0), *(wire.unpack(got[b])[0] for b in np.unique(bucket).tolist())])
        part = np.log(part / vocabulary.sizes[(c.words & U(vocabulary.classes - 1)).astype(np.int64)])
        around = windows(c.tokens, c.by_doc)
        own = np.zeros(len(c.tokens) + 1)
        for s in range(0, len(c.tokens), BATCH):
            own[s + 1 : s + 1 + BATCH] = log_probabilities(w, around[s : s + BATCH], c.tokens[s : s + BATCH])
        own[np.flatnonzero(c.tokens > FREQUENT) + 1] += part[c.rare]
        sums = np.cumsum(own)
        total, n = sums[c.by_doc[1:]] - sums[c.by_doc[:-1]], np.diff(c.by_doc)
        return pa.table({"doc_id": pa.array(c.ids), "n_tokens": pa.array(n), "log_likelihood": pa.array(total), "mean_log_likelihood": pa.array(total / np.maximum(n, 1), mask=n == 0)})

    answers = wire.each_bucket(numbers.mapInArrow(send, wire.CELL), add)
    scores = numbers.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, SCHEMA).withColumn("doc_id", wire.real_id())
    return scores, vocabulary, w
