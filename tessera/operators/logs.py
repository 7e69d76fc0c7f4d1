"""Acceptance of a stored log: one row of figures and verdicts for each key's history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.quantiles import exact_quantiles
from tessera.sources.scratch import written


def check_log(df: DataFrame, key: str, ts: str, order: list[str], value: str, apart: float, low: float, high: float, bands: int, edge: float, parked_s: float) -> DataFrame:
    """D-12: for each key: n, duration_s, near (values not `apart` from both before), fullest and emptiest (the ratio of the
    bands with most and fewest values to the mean band), gap_min, gap_median, gap_max and gap_sd in seconds, parked (gaps of
    parked_s or more), low_spike and high_spike (the share of values within `edge` of a bound, over the share that width
    has of the range: well over 1 where values were cut off and not reflected).

    Values outside [low, high] are in no band; a key without any in it has null ratios, one of a single row null gaps. A
    null value is near to nothing; a null key is a key.
    """
    w = Window.partitionBy(key).orderBy(*order)
    far = lambda k: F.coalesce(F.abs(F.col(value) - F.lag(value, k).over(w)) >= apart, F.lit(True))
    band = F.when(F.col(value).between(low, high), F.least(F.floor((F.col(value) - low) * bands / (high - low)), F.lit(bands - 1)).cast("int"))
    gap = (F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w))) / 1e6
    rows = df.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(value).alias("v"), (~(far(1) & far(2))).alias("near"), gap.alias("gap"), band.alias("band"))
    rows = written(rows, "log")
    inside = F.col("band").isNotNull()
    share = edge / (high - low)
    counts = [F.count_if(F.col("band") == k).alias(f"b{k}") for k in range(bands)]
    own = rows.groupBy("key").agg(
        F.count("*").alias("n"), ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("duration_s"), F.count_if("near").alias("near"),
        F.min("gap").alias("gap_min"), F.max("gap").alias("gap_max"), F.stddev_pop("gap").alias("gap_sd"), F.count_if(F.col("gap") >= parked_s).alias("parked"),
        F.count_if(inside).alias("inside"), F.count_if(inside & (F.col("v") <= low + edge)).alias("at_low"), F.count_if(inside & (F.col("v") >= high - edge)).alias("at_high"), *counts,
    )
    middle = exact_quantiles(rows, "gap", [0.5], ["key"]).select(F.col("key").alias("own"), F.col("quantile").alias("gap_median"))
    own = own.join(middle, F.col("key").eqNullSafe(F.col("own")), "left")
    some, every = F.when(F.col("inside") > 0, F.col("inside")), [F.col(f"b{k}") for k in range(bands)]
    return own.select(
        F.col("key").alias(key), "n", "duration_s", "near", (F.greatest(*every) * bands / some).alias("fullest"), (F.least(*every) * bands / some).alias("emptiest"), "gap_min", "gap_median", "gap_max", "gap_sd", "parked",
        (F.col("at_low") / some / share).alias("low_spike"), (F.col("at_high") / some / share).alias("high_spike"),
    )
