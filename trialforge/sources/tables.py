"""The test and lab tables, one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` under `folder`; which columns and rows are read is left to the optimizer."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
