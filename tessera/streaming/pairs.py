"""Two signals of a device joined on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_same_tick(left: DataFrame, right: DataFrame, key: str, ts: str, tick: str, value: str, late: str) -> DataFrame:
    """The last values of two streams of a key (key, ts, value) in the same tick, as left and right, with the tick's
    beginning; ticks that only one of them has are left out.

    Each stream keeps one row for a key and tick until its watermark, `late` behind its newest row, has passed the tick;
    rows later than that are dropped. The join holds such a row until the other stream's watermark has passed the tick as
    well. Of equal times the larger value counts; rows with a null key or time meet nothing.
    """

    def last(rows: DataFrame, name: str) -> DataFrame:
        own = rows.select(F.col(key).alias(f"{name}_key"), F.col(ts).alias("ts"), F.col(value).alias("v")).withWatermark("ts", late)
        by = own.groupBy(f"{name}_key", F.window("ts", tick).alias(f"{name}_tick"))
        return by.agg(F.max_by("v", F.struct("ts", "v")).alias(name))

    both = F.expr("left_key = right_key AND left_tick = right_tick")
    found = last(left, "left").join(last(right, "right"), both)
    return found.select(F.col("left_key").alias(key), F.col("left_tick.start").alias("tick"), "left", "right")


def stream_within(first: DataFrame, then: DataFrame, key: str, ts: str, most: str, late: str) -> DataFrame:
    """J3 as an interval join: rows of `then` that follow a row of `first` of the same key within `most`, with both times
    and ids (event_id). A row of `first` is held for `most` and `late`, one of `then` for `late`."""
    a = first.select(F.col(key).alias("a_key"), F.col(ts).alias("a_ts"), F.col("event_id").alias("first_id")).withWatermark("a_ts", late)
    b = then.select(F.col(key).alias("b_key"), F.col(ts).alias("b_ts"), F.col("event_id").alias("then_id")).withWatermark("b_ts", late)
    near = F.expr(f"a_key = b_key AND b_ts >= a_ts AND b_ts <= a_ts + INTERVAL {most}")
    return a.join(b, near).select(F.col("a_key").alias(key), "first_id", "then_id", "a_ts", "b_ts")
