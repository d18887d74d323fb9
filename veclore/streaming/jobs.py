"""Streaming forms of deduplication, monthly centroids and windowed counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stream(spark, path: str, schema, files_per_trigger: int | None = 1) -> DataFrame:
    """New parquet files under ``path`` as they come; None: all that are there in one batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def deduplicated(rows: DataFrame, key: Column, at: str, lateness: str) -> DataFrame:
    """The first row of each content key; keys are forgotten once the watermark passes them. Rows without a time are dropped."""
    return rows.where(F.col(at).isNotNull()).withColumn("content_key", key).withWatermark(at, lateness).dropDuplicatesWithinWatermark(["content_key"])


def windowed(rows: DataFrame, at: str, lateness: str, length: str, by: list[str], slide: str | None = None, **measures: Column) -> DataFrame:
    """Measures per time window (tumbling, or sliding with ``slide``) and key; a window is given out once the watermark has passed it."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    out = rows.where(F.col(at).isNotNull()).withWatermark(at, lateness).groupBy(w, *by).agg(*(c.alias(k) for k, c in measures.items()))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, *measures)


def sessions(rows: DataFrame, at: str, lateness: str, gap: str, by: list[str], **measures: Column) -> DataFrame:
    """Measures per session: runs of events of a key with less than ``gap`` between them."""
    out = rows.where(F.col(at).isNotNull()).withWatermark(at, lateness).groupBy(F.session_window(at, gap), *by).agg(*(c.alias(k) for k, c in measures.items()))
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *by, *measures)


def run_to_table(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there now, written to ``path`` exactly once; a later call goes on from the checkpoint."""
    query = rows.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
