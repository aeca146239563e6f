"""Scoring of documents as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_per_window(stream: DataFrame, key: str, at: str = "received_at", late: str = "7 days", window: str = "1 day") -> DataFrame:
    """(key, window, n, last_at): deliveries of each key in event-time windows; rows later than `late` are dropped."""
    timed = stream.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), key)
    return timed.agg(F.count("*").alias("n"), F.max(at).alias("last_at")).select(key, F.col("w.start").alias("window_start"), "n", "last_at")


def score_arrivals(stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Score each micro-batch with a batch function and append it to Parquet at `path`, each batch once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
