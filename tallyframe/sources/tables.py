"""Table source: one Parquet file or folder per table in a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table `name` under `root`."""
    return spark.read.parquet(f"{root}/{name}.parquet")
