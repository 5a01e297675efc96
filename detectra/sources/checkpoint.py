"""Lineage cuts to the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a temporary folder, which only a local session can use."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        conf = spark.conf.get("spark.checkpoint.dir", None)
        if not conf and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(conf or os.path.join(tempfile.gettempdir(), "detectra-checkpoints"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
