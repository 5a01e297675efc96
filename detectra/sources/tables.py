"""Parquet tables and the study tables derived from them by one aggregate each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id"))
    return g.agg(F.sum("l_quantity").cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("n"), F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax"), F.sum("l_extendedprice").alias("signal"))


def order_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"))
    return g.agg(F.sum("l_quantity").cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("n"), F.sum("l_extendedprice").alias("signal"))


def user_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("a"), F.sum("value").alias("signal"))


PART_SQL = "SELECT l_partkey AS id, CAST(sum(l_quantity) AS DOUBLE) AS a, CAST(count(*) AS DOUBLE) AS n, avg(l_discount) AS disc, avg(l_tax) AS tax, sum(l_extendedprice) AS signal FROM lineitem GROUP BY l_partkey"
ORDER_SQL = "SELECT l_orderkey AS id, CAST(sum(l_quantity) AS DOUBLE) AS a, CAST(count(*) AS DOUBLE) AS n, sum(l_extendedprice) AS signal FROM lineitem GROUP BY l_orderkey"
USER_SQL = "SELECT user_id AS id, CAST(count(*) AS DOUBLE) AS a, sum(value) AS signal FROM events GROUP BY user_id"


def supplier_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id"))
    return g.agg(F.sum("l_quantity").cast("double").alias("a"), F.avg("l_discount").alias("disc"), F.sum("l_extendedprice").alias("signal"))
