"""Acceptance reports over logs and tables: checks as rows, budgets, bands and scores."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checks(df: DataFrame, *rules: tuple[str, Column]) -> DataFrame:
    """D-12: a row for each rule with the measured value and whether it holds; a rule's Column is a struct (value, ok)."""
    row = df.agg(*[c.alias(n) for n, c in rules])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n)["value"].cast("double").alias("value"), F.col(n)["ok"].alias("ok")) for n, _ in rules])
    return row.select(F.explode(pairs).alias("x")).select("x.*")


def rule(value: Column, ok) -> Column:
    return F.struct(value.alias("value"), ok(value).alias("ok"))


def weighted_rank(df: DataFrame, scores: dict[str, float], key: str) -> DataFrame:
    """D-29: the weighted sum of scores, and its rank, the largest first; equal sums share a rank, a null one is last.

    Distinct sums are dealt out by range, ranked within a range, and moved on by what the ranges before hold: a row for
    each of 256 ranges is all that one task sees.
    """
    total = sum((F.col(c) * w for c, w in scores.items()), F.lit(0.0))
    rows = df.select(key, total.alias("score"))
    distinct = rows.groupBy("score").agg(F.count("*").alias("n"))
    splits = sorted(set(distinct.approxQuantile("score", [k / 256 for k in range(1, 256)], 0.001)))
    dealt = Bucketizer(splits=[-float("inf"), *(splits or [0.0]), float("inf")], inputCol="score", outputCol="part", handleInvalid="keep").transform(distinct)
    dealt = dealt.withColumn("part", F.when(F.col("score").isNull(), -1).otherwise(F.col("part")))
    within = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above"))
    ranked = dealt.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0))).join(parts, "part")
    rank = ranked.select(F.col("score").alias("_score"), (F.col("before") + F.col("above") + 1).alias("rank"))
    return rows.join(rank, F.col("score").eqNullSafe(F.col("_score"))).drop("_score")


def running_total(df: DataFrame, value: str, key: str, order: list[str]) -> DataFrame:
    """D-35."""
    return df.withColumn("running", F.sum(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def reconcile(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """D-36: both sides of a value, and the difference; what is missing on a side counts as none."""
    j = a.select(key, F.col(value).alias("left")).join(b.select(key, F.col(value).alias("right")), key, "full_outer")
    return j.select(key, "left", "right", (F.coalesce("left", F.lit(0)) - F.coalesce("right", F.lit(0))).alias("difference"))


def worst_of(df: DataFrame, value: str, place: str, key: str, factor: float, most_spread: float) -> DataFrame:
    """D-38: the worst reading of the worst place, times a factor; red where readings of a place spread too far."""
    own = df.groupBy(key, place).agg(F.max(value).alias("worst"), ((F.max(value) - F.min(value)) / F.avg(value)).alias("spread"))
    return own.groupBy(key).agg((F.max("worst") * factor).alias("design"), F.bool_or(F.col("spread") > most_spread).alias("red"))


def pairs_apart(df: DataFrame, key: str, feature: str) -> DataFrame:
    """D-39: for a small table of layers, which pairs share no feature. Pairs that share one meet by an equi-join."""
    each = df.select(key, feature).distinct()
    a, b = each.select(F.col(key).alias("a"), feature), each.select(F.col(key).alias("b"), feature)
    return a.join(b, feature).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def all_pass(df: DataFrame, ok: Column, key: str, n: int) -> DataFrame:
    """D-41: whether a series has n readings or more and all pass."""
    return df.groupBy(key).agg(F.count("*").alias("n"), (F.bool_and(ok) & (F.count("*") >= n)).alias("accepted"))


def centre(df: DataFrame, mass: str, place: str, *keys: str) -> DataFrame:
    """D-28: the centre of gravity."""
    return df.groupBy(*keys).agg((F.sum(F.col(mass) * F.col(place)) / F.sum(mass)).alias("centre"), F.sum(mass).alias("mass"))
