"""Look-ups in small and large tables, and times whatever the session's zone is."""

import random

from pyspark.sql import functions as F

from tessera.operators import sequence
from tessera.plans import QUERIES
from tessera.plans.registry import events


def test_a_hundred_thousand_intervals_without_a_nested_loop(spark):
    n = 100_000
    table = spark.range(n).select((F.col("id") * 2.0).alias("low"), (F.col("id") * 2.0 + 1).alias("high"), F.concat(F.lit("i"), F.col("id").cast("string")).alias("name"))
    rng = random.Random(3)
    values = [rng.choice([0.0, 1.0, 1.5, 2.0, 2.0 * n, -3.0, float("inf")]) if rng.random() < 0.3 else rng.uniform(-5, 2 * n + 5) for _ in range(500)] + [None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v double")
    found = sequence.range_lookup(df, F.col("v"), table, "low", "high", "name")
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    for r in found.collect():
        v = r["v"]
        at = next((k for k in ([int(v // 2), int(v // 2) - 1] if v is not None and abs(v) < 1e9 else []) if 0 <= k < n and 2 * k < v <= 2 * k + 1), None)
        assert r["name"] == (None if at is None else f"i{at}"), v


def test_empty_tables_and_other_kinds(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "v double")
    none = spark.createDataFrame([], "low double, high double, code int")
    assert [r["code"] for r in sequence.range_lookup(df, F.col("v"), none, "low", "high", "code").collect()] == [None, None]
    one = spark.createDataFrame([(0.0, 2.0, 7), (3.0, 1.0, 8), (None, 9.0, 9)], "low double, high double, code int")
    assert {r["v"]: r["code"] for r in sequence.range_lookup(df, F.col("v"), one, "low", "high", "code").collect()} == {1.0: 7, None: None}


def test_times_are_those_of_utc_in_any_session(spark, sf):
    want = events(spark, sf).agg(F.min(F.unix_micros("ts")), F.sum(F.unix_micros("ts") % 1_000_003)).first()
    blocks = sorted(map(str, QUERIES["block_225s_summary"][0](spark, sf).limit(10**6).collect()))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert events(spark, sf).agg(F.min(F.unix_micros("ts")), F.sum(F.unix_micros("ts") % 1_000_003)).first() == want
        assert sorted(map(str, QUERIES["block_225s_summary"][0](spark, sf).limit(10**6).collect())) == blocks
        assert spark.conf.get("spark.sql.session.timeZone") == "America/New_York"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
