"""Nulls, ties, empty tables and other ways for the operators over readings, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import acceptance, gated, profile, sequence
from tessera.streaming import machine

READINGS = "user_id long, event_id long, ts timestamp, value double"
ORDER = ["ts", "event_id"]


@pytest.fixture(scope="module")
def odd(spark):
    """Two users, one without an id; equal times, null values and times."""
    rows = [(1, 1, 10, 5.0), (1, 2, 10, 7.0), (1, 3, 11, None), (1, 4, 12, 9.0), (None, 5, 10, 5.0), (None, 6, 11, 5.0), (None, 7, 12, None), (1, 8, None, 4.0)]
    return spark.createDataFrame(rows, "user_id long, event_id long, s long, value double").withColumn("ts", F.timestamp_seconds("s")).drop("s")


@pytest.mark.parametrize(
    "make",
    [
        lambda d: sequence.consecutive(d, F.col("value") > 4, 2, "user_id", ORDER),
        lambda d: sequence.first_of_runs(d, F.col("value") > 4, 2, "value", "user_id", ORDER),
        lambda d: sequence.slew(d, "value", "ts", "user_id", ORDER),
        lambda d: sequence.two_back(d, "value", 6.0, "user_id", ORDER),
        lambda d: sequence.every_nth(d, 3, "user_id", ORDER),
        lambda d: sequence.heartbeat(d, "ts", 0.5, "user_id", ORDER),
        lambda d: sequence.blocks(d, "ts", 225),
        lambda d: sequence.confirmed_press(d.withColumn("down", F.col("value") > 6), "down", "ts", "user_id"),
        lambda d: sequence.first_fault(d, F.when(F.col("value") > 6, 3), "user_id", ORDER),
        lambda d: sequence.autocorrelation(d, "value", "user_id", ORDER),
        lambda d: sequence.trend(d, "value", "event_id", "user_id"),
        lambda d: sequence.over_baseline(d, "value", 2, 1.1, "user_id", ORDER),
        lambda d: sequence.last_n(d, 2, "user_id", ORDER),
        lambda d: sequence.sample_ticks(d, "ts", 1000, "value", "user_id", ORDER),
        lambda d: sequence.same_tick(d, d, "user_id", "ts", 1000, "value"),
        lambda d: gated.credibility(d, 0.0, 10.0, 5.0, 3),
        lambda d: gated.pi_control(d, 6.0, 0.5, 9.0, 8.0, 0.25, 0.5, 40.0, 80.0),
        lambda d: gated.ou_steps(d.withColumn("noise", F.col("value")), 32.0, 8.0, 6.0, 20.0, 70.0),
        lambda d: machine.transitions(d.withColumn("signal", F.when(F.col("value") > 4, "configured"))),
        lambda d: acceptance.weighted_rank(d, {"value": 1.0}, "event_id"),
        lambda d: acceptance.running_total(d, "value", "user_id", ORDER),
        lambda d: acceptance.worst_of(d, "value", "event_id", "user_id", 1.4, 0.4),
        lambda d: acceptance.all_pass(d, F.col("value") > 4, "user_id", 2),
        lambda d: acceptance.centre(d, "value", "event_id", "user_id"),
        lambda d: acceptance.pairs_apart(d, "user_id", "value"),
        lambda d: acceptance.reconcile(d.groupBy("user_id").agg(F.count("*").alias("v")), d.groupBy("user_id").agg(F.sum("value").alias("v")), "user_id", "v"),
    ],
)
def test_takes_nulls_ties_and_nothing(odd, make):
    rounded = lambda r: str([round(v, 9) if isinstance(v, float) else v for v in r])
    first, again = (sorted(map(rounded, make(d).collect())) for d in (odd, odd.repartition(3)))
    assert first == again  # ties don't depend on where rows lie
    assert make(odd.limit(0)).count() == 0


def test_rows_without_a_key_are_one_key(odd):
    got = {r.event_id: r for r in gated.credibility(odd.filter("user_id IS NULL"), 0.0, 10.0, 5.0, 3).collect()}
    assert [got[k].kept for k in (5, 6, 7)] == [5.0, 5.0, 5.0] and [got[k].bad for k in (5, 6, 7)] == [0, 0, 1]


def test_sampled_tick_takes_the_first_by_order(odd):
    rows = sequence.sample_ticks(odd, "ts", 60_000, "value", "user_id", ORDER, F.col("ts").isNotNull()).collect()
    assert {r.user_id: r.value for r in rows} == {1: 5.0, None: 5.0}


@pytest.mark.parametrize("most", [0, 10 << 20])
def test_range_lookup_of_a_small_and_of_a_large_table(spark, monkeypatch, most):
    monkeypatch.setattr(sequence, "MOST_BROADCAST", most)
    rng = random.Random(4)
    ends = sorted(rng.uniform(0, 1000) for _ in range(800))
    table = [(a, b, k) for k, (a, b) in enumerate(zip(ends[::2], ends[1::2], strict=True))] + [(5000.0, None, -1), (None, 6000.0, -2)]
    values = [None, -1.0, 2000.0, *(rng.uniform(-10, 1010) for _ in range(500)), *(e for e in ends[:40])]
    t = spark.createDataFrame(table, "low double, high double, name int")
    got = sequence.range_lookup(spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double"), F.col("v"), t, "low", "high", "name")
    assert got.columns == ["k", "v", "name"]
    found = {r.k: r.name for r in got.collect()}
    assert found == {k: next((n for a, b, n in table if a is not None and b is not None and v is not None and a < v <= b), None) for k, v in enumerate(values)}


def test_rank_over_ranges_equals_counting(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice([None, *(float(x) for x in range(40)), rng.random()])) for k in range(600)]
    got = {r.k: r["rank"] for r in acceptance.weighted_rank(spark.createDataFrame(rows, "k int, s double"), {"s": 2.0}, "k").collect()}
    assert got == {k: 1 + sum(x is not None and (s is None or x > s) for _, x in rows) for k, s in rows}


def test_profiles_of_nulls_and_of_no_segments(spark):
    df = spark.createDataFrame([(1, 30.0, 26.0), (2, None, 26.0), (3, 0.0, 26.0)], "k int, d double, v double").withColumn("segments", profile.simple_move(F.col("d"), F.col("v"))).withColumn("radius", F.lit(300.0))
    rows = {r.k: r for r in df.select("k", profile.plan_time(F.col("segments")).alias("t"), profile.air_time(F.col("segments"), F.when(F.col("k") == 1, 10.0)).alias("a"), profile.entry_speed(F.col("d"), F.col("v"), F.lit(1.0)).alias("e")).collect()}
    assert rows[1].t > rows[1].a > 0 and rows[3].t == 0 and rows[2].e is None and rows[2].a == rows[3].a == 0
    steps = {r.k: r.n for r in profile.expand(df, "segments", "radius").groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert set(steps) == {1}
