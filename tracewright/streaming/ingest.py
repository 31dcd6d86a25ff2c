"""Streaming extension: new events as files, runs and counts kept up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed_counts(events: DataFrame, time: str, kind: str, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Events of each kind in windows; later ones than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), kind).count().select("window.start", kind, F.col("count").alias("n"))


def upsert_into(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each batch with its number to an idempotent writer; a restart repeats a number, not rows."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
