"""Sums over trees of any depth by pointer doubling: as many rounds as the depth has binary digits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import written


def subtree_sums(nodes: DataFrame, node: str, parent: str, values: list[str], most_rounds: int = 64) -> DataFrame:
    """D-40: for each row of nodes (node, parent, values): node, depth (0 at a root), root, and the sums of the values
    over its subtree, which it is part of.

    A node whose parent is null or isn't there is a root. In round k each node adds its sum, of descendants less than 2^k
    away, to its ancestor 2^k away, and takes that one's ancestor; a node that has none is done. Sums are partial
    aggregates, so a node may have any number of children. Null values count as 0; node ids are to be distinct and not
    null. A cycle is an error. `rounds` of the result's rows tells how many there were.
    """
    rows = nodes.select(F.col(node).alias("node"), F.col(parent).alias("up"), *[F.coalesce(F.col(v), F.lit(0)).alias(v) for v in values])
    known = rows.select(F.col("node").alias("up"), F.lit(True).alias("there"))
    rows = rows.join(known, "up", "left").withColumn("up", F.when(F.col("there"), F.col("up"))).drop("there")
    start = rows.withColumns({"depth": F.when(F.col("up").isNull(), 0).otherwise(1).cast("long"), "root": F.coalesce("up", "node")})
    now = written(start.select("node", "up", "depth", "root", *values), "tree")
    rounds = 0
    while not now.filter("up IS NOT NULL").isEmpty():
        rounds += 1
        if rounds > most_rounds:
            raise ValueError("the parents lead around in a circle")
        sent = now.filter("up IS NOT NULL").groupBy("up").agg(*[F.sum(v).alias(f"{v}_more") for v in values]).withColumnRenamed("up", "node")
        above = now.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("root").alias("top"))
        moved = now.join(sent, "node", "left").join(above, "up", "left")
        now = written(moved.select(
            "node", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0).cast("long"))).alias("depth"), F.coalesce("top", "root").alias("root"),
            *[(F.col(v) + F.coalesce(f"{v}_more", F.lit(0))).alias(v) for v in values],
        ), "tree")
    return now.select(F.col("node").alias(node), "depth", "root", *values, F.lit(rounds).alias("rounds"))
