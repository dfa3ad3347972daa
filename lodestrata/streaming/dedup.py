"""Structured Streaming variants of batch operators. An extension: the rules reproduced here have no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_occurrences(stream: DataFrame, text: str, event_time: str, lateness: str) -> DataFrame:
    """Rows whose text was not seen within the watermark; state is dropped as the watermark passes."""
    marked = stream.withColumn("content_sha256", F.sha2(text, 256)).withWatermark(event_time, lateness)
    return marked.dropDuplicatesWithinWatermark(["content_sha256"])


def windowed_confusion(stream: DataFrame, event_time: str, window: str, lateness: str, threshold: float) -> DataFrame:
    """Counts of ``score >= threshold`` against ``label`` in each window of event time."""
    hit = F.col("score") >= threshold
    counts = {"tp": hit & (F.col("label") == 1), "fp": hit & (F.col("label") == 0), "tn": ~hit & (F.col("label") == 0), "fn": ~hit & (F.col("label") == 1)}
    grouped = stream.withWatermark(event_time, lateness).groupBy(F.window(event_time, window).alias("w")).agg(*[F.count_if(c).alias(k) for k, c in counts.items()])
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *counts)
