"""Panels and second moments over streams of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_panel(events: DataFrame, channel: str, value: str, ts: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, channel, value): means of a channel in each window of time, rows later than `late` left out."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return stamped.groupBy(F.window(ts, width).alias("window"), F.col(channel).alias("channel")).agg(F.avg(value).alias("value"))


def second_moments(samples: DataFrame) -> DataFrame:
    """(i, j, value): running sums of products of the channels of a sample, from rows (cells: map of channel to value).

    Sums of products add up, so a stream gives the moments of all rows so far exactly.
    """
    each = samples.select("cells", F.explode("cells").alias("i", "vi")).select("i", "vi", F.explode("cells").alias("j", "vj"))
    return each.groupBy("i", "j").agg(F.sum(F.col("vi") * F.col("vj")).alias("value"))
