"""Newly landed files as a stream. The batch operators have no streaming counterpart in their source; what a stream can
do exactly is here: first row per key, counts per window, and batch operators run over every micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def landed(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files as they land in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def first_seen(df: DataFrame, keys: Sequence[str], at: str, lateness: str) -> DataFrame:
    """The first row of each key that arrives; keys are forgotten once ``lateness`` has passed."""
    return df.withWatermark(at, lateness).dropDuplicatesWithinWatermark(list(keys))


def counts_per_window(df: DataFrame, by: Sequence[str], at: str, width: str, lateness: str) -> DataFrame:
    """Rows per window and ``by``; rows later than ``lateness`` are left out, as a watermark has it."""
    return df.withWatermark(at, lateness).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *by, "n")


def each_batch(df: DataFrame, stage: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run a batch operator over each micro-batch and write its rows below ``out``, one folder per batch, so that a
    batch run again after a failure replaces its own rows."""

    def write(batch: DataFrame, no: int) -> None:
        stage(batch).write.mode("overwrite").parquet(f"{out}/batch={no}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
