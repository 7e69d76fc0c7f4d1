"""Connected components of links, without gathering them in one place.

Each round first unites the links of a partition by a local union-find, which leaves a link for each node, and then
joins what partitions know of each other: every node tells its larger neighbours, then its smaller ones, of the least
node it sees (large-star and small-star). A link (u, v) has u > v. A round reads and writes a table of links; it ends when a round changes none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, written


#: Parts that a node's links are dealt out in.
SALTS = 16


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) -> (u, least node that this partition links u with), for each u that isn't the least itself."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(up, up)
            x = parent[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for i in range(0, len(nodes), 50_000):
        pairs = [(x, r) for x in nodes[i : i + 50_000] if (r := root(x)) != x]
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], names=["u", "v"])


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the least node reachable) for every node of `links` (u, v: longs) that isn't its own component."""
    now, seen = written(links.select("u", "v").mapInArrow(_unite, "u long, v long"), "links"), None
    for _ in range(most_rounds):
        # what the least neighbour of a parent is matters where the parent is a child itself: few nodes, so that these go
        # to every part of a parent's links, which a hub may have very many of
        above = now.groupBy("u").agg(F.min("v").alias("m"))
        middle = above.join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select(F.col("u").alias("v"), "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        parts = now.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int"))
        large = parts.join(middle, ["v", "salt"], "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u != v").distinct()
        new = written(small, "links")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = new
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = state
    raise RuntimeError(f"links still change after {most_rounds} rounds")
