"""The registered query of each operator: its production parameters on its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, exact, kdtree, langid, lines, lm, mixing, near, sql, substring, suffix, tokens, warc, whiten, wire

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out() -> Column:
    """Documents that language models of op1 never learn from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = langid.predict(docs, langid.fit(docs.filter(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup(documents(spark, sf_dir), length=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.dedup(documents(spark, sf_dir), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count(documents(spark, sf_dir), fields=("text",), rule="most")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.find(documents(spark, sf_dir), shingle=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup(documents(spark, sf_dir), percent=80, whole=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(documents(spark, sf_dir), keep="largest")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=16)
    return out.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{wire.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder, least=0)
    out = warc.read(spark, folder, payloads=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=40, rounds=5, scale=256, dim=64, seed=2)


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_lm_score": op2_lm_score,
    "op3_decontaminate": op3_decontaminate,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_near_dedup": op7_near_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_mixing": op10_mixing,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_warc": op12_warc,
    "op13_centroid_clustering": op13_centroid_clustering,
}

ORACLES: dict[str, str] = {
    "op3_decontaminate": sql.DECONTAMINATE,
    "op4_substring_dedup": sql.SUBSTRING,
    "op7_near_dedup": sql.NEAR,
    "op9_exact_dedup": sql.EXACT,
    "op12_warc": sql.WARC,
    "op13_centroid_clustering": sql.clustering_sql(),
}
