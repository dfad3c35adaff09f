"""Extensions with Structured Streaming: stacks that are kept up to date as frames
arrive, and windowed aggregates of events with late data.

Sums and means need only two numbers a pixel, which Spark keeps as grouped
aggregate state; windows over events drop state behind a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_stack(pixels: DataFrame, keys: tuple[str, ...] = ("x", "y", "c")) -> DataFrame:
    """Running mean and count of each pixel over all frames so far (update or complete mode)."""
    some = pixels.where("v != 0")
    return some.groupBy(*keys).agg(F.avg("v").alias("v"), F.count("*").alias("n"))


def windowed(events: DataFrame, time: str = "ts", width: str = "1 hour", slide: str | None = None, delay: str = "10 minutes", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums of tumbling or sliding windows, closed by a watermark."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = events.withWatermark(time, delay).groupBy(w, *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), *by, "n", "total")


def sessions(events: DataFrame, time: str = "ts", gap: str = "30 minutes", delay: str = "1 hour", by: str = "user_id") -> DataFrame:
    """Session windows by key: events less than a gap apart."""
    out = events.withWatermark(time, delay).groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n", "total")


def run_available(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over all data now there, into a memory table (for small results and tests)."""
    spark = stream.sparkSession
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.table(name)
