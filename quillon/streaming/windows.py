"""Window features of events as they arrive: the batch statistics' streaming form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def token_counts(events: DataFrame, time: str = "ts", width: str = "24 hours", lateness: str = "1 hour", keys: tuple[str, ...] = ("stay_id", "token")) -> DataFrame:
    """Per key and tumbling window of event time: events, numbers, their sum, least and largest. events streams (or not);
    a window is final once the watermark, `lateness` behind the latest event, has passed it, and its state goes then.
    Later events are left out by Spark; events without a time or token count nowhere."""
    held = events.where(F.col(time).isNotNull() & F.col(keys[-1]).isNotNull()).withWatermark(time, lateness)
    out = held.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("events"), F.count("value").alias("numbers"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("largest"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "events", "numbers", "total", "least", "largest")
