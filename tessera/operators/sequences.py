"""Sequences that are equal, and how far they are: fingerprints of prefixes."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.blocked import affine, blocked_fold
from tessera.sources.scratch import written

#: Fingerprints are polynomials of BASE modulo a prime below 2^61.
PRIME, BASE = (1 << 61) - 1, 911_382_323_911_382_323


def _item(item: str | None) -> int:
    data = b"\0" if item is None else b"\1" + item.encode()
    return (zlib.crc32(data) << 28 ^ zlib.adler32(data)) % PRIME


def _of(item: str | None) -> tuple[int, int]:
    return BASE, _item(item)


def _step(state: tuple | None, item: str | None) -> tuple:
    x, n = state or (0, 0)
    x, n = (x * BASE + _item(item)) % PRIME, n + 1
    return (x, n), (n, x, item)


def shared_prefixes(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """D-14: for each key with a sequence of values: length, same_as, common_prefix, first_with_it.

    same_as is the smallest key whose whole sequence is equal (itself, if none is smaller), common_prefix the length of the
    longest prefix that another key's sequence begins with too (0 if none), first_with_it the smallest key whose sequence
    begins so, itself included (null where common_prefix is 0). Values are compared as text, a null only equals a null;
    rows with a null key are left out; ties in order are to be broken by the caller. Prefixes are found by fingerprints
    that merge, so that a key with very many rows is read by many tasks, and confirmed on the values: a prefix counts as far
    as its values agree with those of the smallest key that has its fingerprint.
    """
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), *order, F.col(value).cast("string").alias("item"))
    steps = blocked_fold(rows, _step, affine(_of, PRIME), "key", order, ["item"], "n long, x long, item string")
    steps = written(steps, "prefixes")
    groups = steps.groupBy("n", "x").agg(F.count("*").alias("keys"), F.min("key").alias("first"))
    length = steps.groupBy("key").agg(F.max("n").alias("length"))
    shared = steps.select("key", "n", "x").join(groups.filter("keys > 1"), ["n", "x"])
    longest = shared.groupBy("key").agg(F.max("n").alias("n"), F.max_by("first", "n").alias("first"))
    # a key that is the smallest itself is confirmed by the next one that has the prefix
    others = shared.filter("key > first").groupBy("n", "x").agg(F.min("key").alias("next"))
    at = shared.join(longest.select("key", "n"), ["key", "n"]).join(others, ["n", "x"], "left")
    pairs = at.select("key", "n", "first", F.when(F.col("key") == F.col("first"), F.col("next")).otherwise(F.col("first")).alias("other"))
    own = pairs.join(steps.select("key", F.col("n").alias("k"), "item"), "key").filter("k <= n")
    met = own.join(steps.select(F.col("key").alias("other"), F.col("n").alias("k"), F.col("item").alias("theirs")), ["other", "k"])
    agreed = met.groupBy("key").agg(F.min(F.when(~F.col("item").eqNullSafe(F.col("theirs")), F.col("k"))).alias("differs"), F.first("n").alias("n"), F.first("first").alias("first"))
    agreed = agreed.select("key", F.coalesce(F.col("differs") - 1, F.col("n")).alias("common_prefix"), "first")
    ends = steps.join(length, "key").filter("n = length").select("key", "length", "x")
    same = F.min("key").over(Window.partitionBy("length", "x"))  # a row for each key
    out = ends.withColumn("same_as", same).join(agreed, "key", "left")
    found = F.coalesce("common_prefix", F.lit(0).cast("long"))
    return out.select(F.col("key").alias(key), "length", "same_as", found.alias("common_prefix"), F.when(found > 0, F.col("first")).alias("first_with_it"))
