"""Table access: one Parquet file or folder per table below a common directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` below ``folder``; filters and column choices reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
