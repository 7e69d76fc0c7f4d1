"""Exact quantiles by refining histograms of the sortable bits of a double: no sort, and no task with all values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, LongType

from tessera.sources.scratch import written

#: Bits that each of the rounds refines by.
BITS, ROUNDS = 16, 4


@pandas_udf(LongType())
def sortable(values: pd.Series) -> pd.Series:
    """The bits of a double as a long in the same order; -0.0 is 0.0, and all NaN are one, above infinity."""
    x = np.where(values.isna(), np.nan, values.to_numpy(dtype=float, na_value=np.nan)) + 0.0
    bits = np.ascontiguousarray(x).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


@pandas_udf(DoubleType())
def unsorted(bits: pd.Series) -> pd.Series:
    """The double of sortable bits."""
    b = bits.to_numpy(dtype=np.int64)
    return pd.Series(np.where(b < 0, b ^ np.int64(0x7FFFFFFFFFFFFFFF), b).view(np.float64))


def _digits(bits: Column, level: int) -> Column:
    """The leading (level + 1) * BITS bits, from the least possible one as 0."""
    return F.shiftright(bits, BITS * (ROUNDS - 1 - level))


def order_statistics(df: DataFrame, value: str, ranks: DataFrame, by: list[str]) -> DataFrame:
    """The value of each rank (from 0) of `ranks` (by..., rank): by..., rank, value. Nulls are no values.

    Each round counts values by the next 16 bits, of those that share their leading bits with a value looked for, and
    goes on in the bucket that holds the rank: 65,536 counts for each of these at most, from partial sums.
    """
    keys = [F.col(c) for c in by]

    def alike(names: list[str]) -> Column:
        """Rows with equal columns, nulls too, where the other side's begin with _."""
        same = F.lit(True)
        for c in names:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return same

    def aside(df: DataFrame, names: list[str]) -> DataFrame:
        return df.withColumnsRenamed({c: f"_{c}" for c in names})

    bits = written(df.filter(F.col(value).isNotNull()).select(*keys, sortable(F.col(value).cast("double")).alias("bits")), "bits")
    goal = ranks.select(*keys, "rank", F.col("rank").alias("left"), F.shiftright("rank", 63).alias("prefix"))  # 0, so that joins have a key
    for level in range(ROUNDS):
        inside = bits.withColumn("digits", _digits(F.col("bits"), level))
        if level:
            inside = inside.withColumn("prefix", _digits(F.col("bits"), level - 1)).join(aside(goal.select(*by, "prefix").distinct(), [*by, "prefix"]), alike([*by, "prefix"]), "left_semi")
        bars = inside.groupBy(*by, *(["prefix"] if level else []), "digits").agg(F.count("*").alias("n"))
        if not level:
            bars = bars.withColumn("prefix", F.shiftright("n", 63))
        upto = F.sum("n").over(Window.partitionBy(*by, "prefix").orderBy("digits"))
        bars = bars.withColumn("upto", upto)
        met = goal.join(aside(bars, [*by, "prefix"]), alike([*by, "prefix"]) & (F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("n")))
        goal = written(met.select(*by, "rank", (F.col("left") - F.col("upto") + F.col("n")).alias("left"), F.col("digits").alias("prefix")), "goal")
    return goal.select(*by, "rank", unsorted("prefix").alias("value"))


def exact_quantiles(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """by..., share, quantile for each share: between the two values next to share * (n - 1), in proportion.

    Groups without a value have no row. NaN is above all. Keys of `by` may be null.
    """
    by = by or []
    sizes = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("size")).filter("size > 0")
    each = sizes.withColumn("share", F.explode(F.array(*map(F.lit, map(float, shares))))).withColumn("at", F.col("share") * (F.col("size") - 1))
    each = written(each.select(*by, "share", F.floor("at").alias("low"), F.ceil("at").alias("high"), "at"), "shares")
    ranks = each.select(*by, F.col("low").alias("rank")).union(each.select(*by, F.col("high").alias("rank"))).distinct()
    found = order_statistics(df, value, ranks, by)
    for side in ("low", "high"):
        own = found.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("rank").alias("_rank"), F.col("value").alias(f"{side}_value"))
        same = F.col(side) == F.col("_rank")
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        each = each.join(own, same).drop("_rank", *[f"_{c}" for c in by])
    between = F.when(F.col("low") == F.col("high"), F.col("low_value")).otherwise(F.col("low_value") + (F.col("high_value") - F.col("low_value")) * (F.col("at") - F.col("low")))
    return each.select(*by, "share", between.alias("quantile"))
