"""Exact dedup by content sort, in DataFrame operations only.

Normalised texts are range-partitioned by sampled splitters and sorted on disk where they do not fit
in memory, so equal texts become neighbours; neighbouring rows are compared in full.  A splitter is
the first characters and a hash of a text with a salt of its document, so what is sampled is
bounded, equal texts still sort together, and a text that a third of all rows share is dealt over
``SALTS`` ranges.  Each run of equal texts in a range gives one row; runs of one text are joined by
the digest of the text, from at most ``SALTS`` rows for each text, and the rows of a run look up
their group by digest and salt, so no task gets all rows of a text.

Null counts as empty, and empty texts are equal to each other.  Repeated doc_ids are separate rows.
A null doc_id sorts before all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import wire

SALTS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; the fast path is for texts that are all ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def groups(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest (or smallest) doc_id stays; of repeated rows with that
    id, one.
    """
    best, order = (F.max, F.desc) if keep == "largest" else (F.min, F.asc)
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(wire.NULL_ID)).alias("doc_id"),
        ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("norm"),
    )
    rows = rows.withColumns({"head": F.substring("norm", 1, 24), "print": F.xxhash64("norm"), "salt": F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")})
    parts = wire.pieces(docs, 8 << 20)
    ranged = rows.repartitionByRange(parts, "head", "print", "salt")
    run = Window.partitionBy("head", "print", "norm", "salt")
    ordered = run.orderBy(order("doc_id"))
    marked = ranged.select(
        "doc_id",
        "salt",
        F.sha2("norm", 256).alias("text_sha256"),
        F.row_number().over(ordered).alias("place"),
        F.count(F.lit(1)).over(run).alias("here"),
    )
    slim = wire.cut(marked)
    whole = slim.filter("place = 1").groupBy("text_sha256").agg(best("doc_id").alias("keep_id"), F.sum("here").alias("group_size"), F.collect_list("salt").alias("salts"))
    by_run = whole.select(F.col("text_sha256").alias("digest"), "keep_id", "group_size", F.explode("salts").alias("run_salt"))
    found = slim.join(by_run, (F.col("text_sha256") == F.col("digest")) & (F.col("salt") == F.col("run_salt")))
    return found.select(
        wire.real_id(),
        F.when(F.col("keep_id") != wire.NULL_ID, F.col("keep_id")).alias("keep_id"),
        "group_size",
        ((F.col("doc_id") == F.col("keep_id")) & (F.col("place") == 1)).alias("kept"),
        "text_sha256",
    )
