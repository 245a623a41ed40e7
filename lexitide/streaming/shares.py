"""An extension: shares of marked texts over a stream, with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.functions import stats


def windowed_shares(stream: DataFrame, time: str, flag: str, window: str = "30 days", late: str | None = "90 days", keys: tuple[str, ...] = ()) -> DataFrame:
    """(window_start, keys, count, mean, ci_lower, ci_upper) of tumbling windows of event time.

    Counts and hits add up, so the state of a window is two numbers for each group; rows later than ``late`` are
    dropped with the window's state; None keeps the watermark that the stream has. Works on a static table too, where
    it counts all rows.
    """
    timed = stream.withWatermark(time, late) if stream.isStreaming and late else stream
    counted = timed.groupBy(F.window(time, window).alias("w"), *keys).agg(F.count(flag).alias("count"), F.avg(F.col(flag).cast("double")).alias("mean"))
    lower, upper = stats.wilson(F.col("mean"), F.col("count"))
    return counted.select(F.col("w.start").alias("window_start"), *keys, "count", "mean", lower.alias("ci_lower"), upper.alias("ci_upper"))


def newest_version(stream: DataFrame, key: str, time: str, late: str = "90 days") -> DataFrame:
    """The stream without rows that repeat a key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
