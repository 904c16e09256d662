"""Structured Streaming forms: journals, idempotent arrivals, live windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

TERMINAL = ("finish", "failed", "skipped", "cache_hit")


def stage_status(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Latest status, attempts and last time per run and stage; events: run_id, stage, at, event, status, attempt. Batch or stream (update mode)."""
    e = events.withWatermark("at", late) if events.isStreaming else events
    return e.groupBy("run_id", "stage").agg(F.max_by("status", "at").alias("status"), F.max("attempt").alias("attempts"), F.max("at").alias("at"), F.sum(F.when(F.col("event") == "finish", F.col("elapsed_s")).otherwise(0.0)).alias("elapsed_s"))


def binned(df: DataFrame, width: str, aggs: list[Column], keys: list[str], slide: str | None = None, late: str = "1 minute", at: str = "ts") -> DataFrame:
    """Tumbling, or with slide overlapping, windows; late rows beyond the watermark are left out of streams."""
    x = df.withWatermark(at, late) if df.isStreaming else df
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return x.groupBy(*keys, w.alias("w")).agg(*aggs).withColumns({"window_start": F.col("w.start"), "window_end": F.col("w.end")}).drop("w")


def sessions(df: DataFrame, gap: str, aggs: list[Column], keys: list[str], late: str = "1 minute", at: str = "ts") -> DataFrame:
    """Events of a key that follow each other within the gap, as one session."""
    x = df.withWatermark(at, late) if df.isStreaming else df
    return x.groupBy(*keys, F.session_window(at, gap).alias("w")).agg(*aggs).withColumns({"window_start": F.col("w.start"), "window_end": F.col("w.end")}).drop("w")


def first_arrivals(packages: DataFrame, late: str = "1 day") -> DataFrame:
    """Packages without those whose hash has arrived before."""
    if packages.isStreaming:
        return packages.withWatermark("arrived_at", late).dropDuplicatesWithinWatermark(["package_sha256"])
    return packages.dropDuplicates(["package_sha256"])


def start(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "update") -> StreamingQuery:
    """Run each micro-batch through `write` once; the checkpoint makes restarts continue."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
