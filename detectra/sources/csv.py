"""CSV in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import clean_headers


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with cleaned headers.  Without a schema all columns are text, which validation coerces."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return df.toDF(*clean_headers(df.columns))


def default_outcome(df: DataFrame) -> str:
    """The last column."""
    return df.columns[-1]


def write_csv(df: DataFrame, path: str) -> None:
    """The whole data set, replacing what was there."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(frames: dict[str, DataFrame], path: str, format: str = "parquet") -> None:
    """Result tables as one folder each."""
    for name, df in frames.items():
        writer = df.write.mode("overwrite")
        (writer.option("header", True).csv if format == "csv" else writer.parquet)(f"{path}/{name}")
