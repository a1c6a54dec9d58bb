"""Streams of events.  An extension: the engine's own operators are batch only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Rows with a time, as a timestamp: watermarks do not take times without a zone."""
    return events.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling_counts(events: DataFrame, late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total) per window; rows later than ``late`` behind the newest are dropped by the stream."""
    by = _timed(events, late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user_id, started, ended, n) of each user's sessions."""
    by = _timed(events.where("user_id is not null"), late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return by.select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def first_deliveries(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event_id once, within the watermark."""
    return _timed(events, late).dropDuplicatesWithinWatermark(["event_id"])


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now and give its result as a table."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
