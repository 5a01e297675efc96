"""Token counts by offset-mapped attribution.

A document, which is its fields one after another with a newline between them, is encoded once as a
whole.  A byte-level vocabulary loses nothing, so running sums of token lengths are the tokens' byte
spans.  The spans are interval-joined to the sections of the fields; a section is a line with the
newline that ends it.  A token that crosses a boundary belongs, by rule, to the section with its
``first`` byte, its ``last`` byte, or ``most`` of its bytes (of ties the first section).

A null field counts as empty; a document of empty fields has a section for each field and no token
but those of the newlines between them.  The vocabulary is a file of base64 tokens and ranks, which
every executor can read at ``path``.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wire

#: How the vocabularies' byte-level pre-tokeniser splits text; a fixed value of theirs.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SCHEMA = "doc_id long, n_bytes long, n_tokens long, n_crossing long, field_tokens array<long>, section_tokens array<long>"


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def attribute(lengths: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section, from token lengths and section ends in bytes, and how many tokens cross."""
    to = np.cumsum(lengths)
    first = np.searchsorted(ends, to - lengths, "right")
    last = np.searchsorted(ends, to - 1, "right")
    own = last.copy() if rule == "last" else first.copy()
    crossing = np.flatnonzero(first < last)
    if rule == "most":
        for t in crossing.tolist():
            s, e = to[t] - lengths[t], to[t]
            sections = np.arange(first[t], last[t] + 1)
            upper = np.minimum(ends[sections], e)
            lower = np.maximum(np.where(sections > 0, ends[sections - 1], 0), s)
            own[t] = sections[np.argmax(upper - lower)]
    return np.bincount(own, minlength=len(ends)), len(crossing)


def count(docs: DataFrame, fields: Sequence[str] = ("text",), path: str = VOCABULARY, rule: str = "most") -> DataFrame:
    """One row for each input row: doc_id, n_bytes, n_tokens, n_crossing, field_tokens, section_tokens."""
    if rule not in ("first", "last", "most"):
        raise ValueError(f"unknown rule {rule!r}")
    names = [f"f{i}" for i in range(len(fields))]
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(wire.NULL_ID)).alias("doc_id"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in zip(fields, names)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        enc, lengths = encoder(path)
        for b in batches:
            columns = [b.column(n).to_pylist() for n in names]
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_tokens", "n_crossing", "field_tokens", "section_tokens")}
            for parts in zip(*columns):
                text = "\n".join(parts)
                raw = np.frombuffer(text.encode(), np.uint8)
                ends = np.append(np.flatnonzero(raw == 10) + 1, len(raw))
                own = lengths[np.asarray(enc.encode_to_numpy(text, allowed_special=set(), disallowed_special=()), np.int64)]
                by_section, crossing = attribute(own, ends, rule)
                sizes = [x.count("\n") + 1 for x in parts]
                out["n_bytes"].append(len(raw)), out["n_tokens"].append(len(own)), out["n_crossing"].append(crossing)
                out["section_tokens"].append(by_section)
                out["field_tokens"].append(np.add.reduceat(by_section, np.cumsum([0, *sizes[:-1]])))
            kinds = {k: pa.list_(pa.int64()) if k in ("field_tokens", "section_tokens") else pa.int64() for k in out}
            yield pa.record_batch({"doc_id": b.column("doc_id")} | {k: pa.array(v, kinds[k]) for k, v in out.items()})

    return rows.mapInArrow(run, SCHEMA).withColumn("doc_id", wire.real_id())


