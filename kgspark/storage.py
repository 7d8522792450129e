"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_unset = ""  # the local folder that stands in where the setting is missing


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; set to a local one only where unset."""
    global _unset
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        _unset = _unset or tempfile.mkdtemp(prefix="spark-")
        top = _unset
    return f"{top.rstrip('/')}/kgspark-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows of df, written as Parquet to the shared folder and read again: what follows doesn't recompute them."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")
