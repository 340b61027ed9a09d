"""Votes over an append-only stream of judgments: an extension, the reference has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.judging import majority_label


def streaming_votes(judgments: DataFrame, event_time: str, window: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Majority and counts of labels by prompt and event-time window; rows later than the watermark are left out."""
    by = judgments.withWatermark(event_time, lateness).groupBy("prompt_id", F.window(event_time, window))
    return by.agg(majority_label(F.col("letter")).alias("pref_majority"), F.count("*").alias("n"))
