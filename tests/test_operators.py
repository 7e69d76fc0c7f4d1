import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import process, sensor
from tessera.operators import acceptance, profile, sequence, session
from tessera.sources import golden, records


def test_beta_temperature_ends_of_scale(spark):
    rows = spark.createDataFrame([(0,), (4095,), (None,), (1696,)], "adc int").select(sensor.beta_temperature(F.col("adc")).alias("t")).collect()
    assert [r.t for r in rows[:3]] == [None, None, None]
    assert abs(rows[3].t - 33) < 0.5


def test_fnv_known_values(spark):
    rows = spark.createDataFrame([("",), ("a",), ("foobar",)], "s string").select(sensor.fnv1a(F.col("s")).alias("h")).collect()
    assert [r.h for r in rows] == [0x811C9DC5, 0xE40C292C, 0xBF9CF968]


def test_reflection_is_the_fold_of_repeated_mirrors(spark):
    xs = np.random.default_rng(1).uniform(-150, 250, 500)

    def mirrored(x):
        for _ in range(40):
            x = 40 - x if x < 20 else 140 - x if x > 70 else x
        return x

    got = spark.createDataFrame([(float(x),) for x in xs], "x double").select(process.reflect(F.col("x"), 20, 70).alias("y")).collect()
    assert np.allclose([r.y for r in got], [mirrored(x) for x in xs])


def test_generator_in_sql_and_python_agree(spark):
    draws = session.Draws(4096, golden.FIRMWARE)
    want = [draws.uniform() for _ in range(20)]
    row = spark.range(1).select(F.transform(process.xorshift_states(F.lit(4096).cast("long"), 20), process.uniform).alias("u")).first()
    assert row.u == want


def test_bounded_walk_moments(spark):
    """The published moments of the bounded process, from 60 paths of 1,000 steps."""
    axes = {"v": (6.0, 2.6, 0.8, 2.0, 7.0)}
    xs = np.array([[d.walk("v") for _ in range(1000)] for d in (session.Draws(1000 + k * 7919, axes) for k in range(60))])
    _, mean, sd, step, _ = golden.OU_MOMENTS[0]
    assert abs(xs.mean() - mean) < 0.03 and abs(xs.std() - sd) < 0.03 and abs(np.abs(np.diff(xs)).mean() - step) < 0.01


@pytest.mark.parametrize("param_set", ["firmware", "bench"])
def test_sessions_keep_their_invariants(spark, param_set):
    s = session.simulate(golden.seeds(spark, 40), param_set).toPandas().sort_values(["session_id", "n"])
    axes = golden.PARAMETERS[param_set]
    assert s.cruise.between(*axes["velocity"][3:]).all() and s.gap_s.dropna().between(*axes["gap"][3:]).all()
    assert (s.dwell_s <= 10).all() and (s.t_s + s.seconds + s.dwell_s <= 860 + 1e-6).all()
    for _, own in s.groupby("session_id"):
        assert 45 <= len(own) <= 85
        moves = own.target.dropna().to_numpy()
        assert (np.abs(np.diff(moves)) >= 6 - 1e-9).all() and (np.abs(moves) <= 24).all()
        after = own.from_deg != 43  # a visit to the cup begins anew
        assert not (own.kind.eq("graze") & own.kind.shift().eq("graze") & after).any()


def test_session_is_the_same_again(spark):
    a, b = (session.simulate(golden.seeds(spark, 3)).orderBy("session_id", "n").collect() for _ in range(2))
    assert a == b


def test_choose_ties_history_and_no_room(spark):
    def pick(cur, guide, h1, h2):
        c = sequence.choose(sequence.candidates(F.lit(cur), 6.0, 12.0, 0.5), F.lit(guide), -24.0, 24.0, [F.lit(h1).cast("double"), F.lit(h2).cast("double")], 6.0, F.lit(cur))
        return spark.range(1).select(c.alias("c")).first().c

    assert pick(0.0, 0.0, None, None) == -6.0  # the first of equals
    assert pick(0.0, 9.2, None, None) == 9.0
    assert pick(0.0, 9.2, 9.0, None) == -6.0
    assert pick(24.0, 24.0, 15.0, 15.0) == 24.0


def test_profile_time_equals_its_steps(spark):
    df = spark.createDataFrame([(43.0, -38.0, 30.0, 1.4, 300.0, False), (22.0, -38.0, 45.0, 1.0, 290.0, False), (43.0, -22.5, 25.0, 2.0, 310.0, True)], "from_deg double, to_deg double, cruise double, ramp_s double, radius double, graze boolean")
    strokes = profile.with_stroke(df).withColumn("k", F.monotonically_increasing_id())
    est = {r.k: r.t for r in strokes.select("k", profile.plan_time(F.col("segments")).alias("t")).collect()}
    real = profile.expand(strokes, "segments", "radius").groupBy("k").agg((F.sum("interval_us") / 1e6).alias("t"), F.max("realised").alias("v"), F.min("interval_us").alias("us")).collect()
    for r in real:
        assert abs(r.t - est[r.k]) < 0.01 * est[r.k] and r.v <= 100 and r.us >= 240
    rows = strokes.select(F.size("segments").alias("n"), F.transform("segments", lambda x: x["s1"] - x["s0"]).alias("l"), "air_from").collect()
    assert all(r.n <= 10 and min(r.l) > 0.01 for r in rows) and rows[2].air_from is None


def test_entry_speed_meets_the_ramp_or_its_bound(spark):
    df = spark.createDataFrame([(36.65, 30.0, t) for t in (0.1, 1.2, 60.0)], "l double, c double, t double")
    df = df.withColumn("v", profile.entry_speed(F.col("l"), F.col("c"), F.col("t")))
    rows = df.withColumn("took", sensor.segment_time(F.col("l"), F.col("v"), F.col("c"), F.lit(False))).collect()
    assert rows[0].v == 70 and rows[2].v == 5 and abs(rows[1].took - 1.2) < 1e-3


def test_interval_algebra(spark):
    def run(c):
        return spark.range(1).select(c.alias("x")).first().x

    whole = F.array(F.struct(F.lit(0.0).alias("lo"), F.lit(10.0).alias("hi")))
    cut = sequence.subtract_interval(whole, F.lit(4.0), F.lit(6.0))
    assert [(i.lo, i.hi) for i in run(cut)] == [(0, 4), (6, 10)]
    assert [(i.lo, i.hi) for i in run(sequence.clip_intervals(cut, F.lit(3.0), F.lit(7.0)))] == [(3, 4), (6, 7)]
    assert run(sequence.draw_from_intervals(cut, F.lit(0.75))) == 8.0
    assert run(sequence.draw_from_intervals(F.filter(cut, lambda i: i["lo"] > 50), F.lit(0.5))) is None


def test_relaxed_radius_keeps_apart_where_there_is_room(spark):
    for cur, h1, u in ((0.0, 8.0, 0.3), (20.0, 18.0, 0.9), (-24.0, -10.0, 0.5)):
        r = spark.range(1).select(sequence.draw_radius(F.lit(u), F.lit(cur), [F.lit(h1), F.lit(None).cast("double")], -24.0, 24.0, 6.0, 12.0).alias("r")).first().r
        assert -24 <= r <= 24 and abs(r - cur) >= 6 - 1e-9 and abs(r - h1) >= 6 - 1e-9


def test_records_checksum_defaults_and_erase(spark, tmp_path):
    path = str(tmp_path / "records")
    rows = spark.createDataFrame([(1, k, k % 3, 10 * k) for k in range(1, 8)] + [(2, 1, 0, 5)], "device_id long, at int, fault int, error int")
    records.save_records(rows, path)
    got = {r.device_id: r for r in records.load_records(spark, path).collect()}
    assert got[1].valid and got[1].sessions == 7 and got[1].errors == [30, 40, 50, 60, 70] and got[1].last_fault == 1
    bad = spark.read.parquet(path).withColumn("sessions", F.col("sessions") + 1)
    bad.write.parquet(path + "2")
    assert all(not r.valid and r.sessions == 0 and r.errors == [] for r in records.load_records(spark, path + "2").collect())
    records.erase_records(spark, path)
    assert records.load_records(spark, path).count() == 0


def test_acceptance_holds_and_fails(spark):
    df = spark.range(10)
    out = acceptance.checks(df, ("most", acceptance.rule(F.max("id"), lambda v: v < 9)), ("least", acceptance.rule(F.min("id"), lambda v: v == 0)))
    assert {r.rule: r.ok for r in out.collect()} == {"most": False, "least": True}


def test_weight_force_golden(spark):
    assert all(round(0.040875 * (4785 + 40 * mm)) == mn for mm, mn in golden.WEIGHT_SCALE)
    assert math.isclose(sum(q * c for own in golden.PARTS.values() for q, c in own), 14545)


def test_xoshiro_and_splitmix_against_plain_arithmetic(spark):
    mask = 0xFFFFFFFF
    turn = lambda x, k: (x << k & mask) | x >> (32 - k)

    def mix(x):
        z = (x + 0x9E3779B9) & mask
        z = (z ^ z >> 16) * 0x85EBCA6B & mask
        z = (z ^ z >> 13) * 0xC2B2AE35 & mask
        return z ^ z >> 16

    s = [mix(12345 + k) for k in range(4)]
    want, t = [], list(s)
    for _ in range(20):
        want.append(turn(t[1] * 5 & mask, 7) * 9 & mask)
        u = t[1] << 9 & mask
        t[2] ^= t[0]
        t[3] ^= t[1]
        t[1] ^= t[2]
        t[0] ^= t[3]
        t[2] ^= u
        t[3] = turn(t[3], 11)
    row = spark.range(1).select(F.array(*[process.splitmix32(F.lit(12345 + k).cast("long")) for k in range(4)]).alias("s"))
    got = row.select("s", process.xoshiro128(F.col("s"), 20).alias("x")).first()
    assert got.s == s and got.x == want


def test_choose_equals_brute_force_on_random_cases(spark):
    rng = np.random.default_rng(5)
    rows = [(k, float(np.round(rng.uniform(-24, 24) * 2) / 2), float(rng.uniform(-24, 24)), *[float(v) if rng.random() < 0.8 else None for v in rng.uniform(-24, 24, 2)]) for k in range(400)]

    def brute(cur, guide, *history):
        fit = [c for s in (-1, 1) for d in range(13) if -24 <= (c := cur + s * (6 + d / 2)) <= 24 and all(h is None or abs(c - h) >= 6 for h in history)]
        return min(fit, key=lambda c: abs(c - guide)) if fit else cur

    df = spark.createDataFrame(rows, "k int, cur double, guide double, h1 double, h2 double")
    best = sequence.choose(sequence.candidates(F.col("cur"), 6.0, 12.0, 0.5), F.col("guide"), -24.0, 24.0, [F.col("h1"), F.col("h2")], 6.0, F.col("cur"))
    got = {r.k: r.best for r in df.select("k", best.alias("best")).collect()}
    assert all(got[k] == brute(*args) for k, *args in rows)


def test_runs_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(5)), k, bool(rng.random() < 0.6)) for k in range(500)]
    run, want = {}, []
    for user, k, hit in rows:
        run[user] = run.get(user, 0) + 1 if hit else 0
        if run[user] >= 3:
            want.append((k, run[user]))
    df = spark.createDataFrame(rows, "user_id int, k int, hit0 boolean")
    got = sequence.consecutive(df, F.col("hit0"), 3, "user_id", ["k"])
    assert sorted((r.k, r.run) for r in got.collect()) == sorted(want)


def test_confirmed_press_of_a_bouncing_switch(spark):
    levels = [(0, False), (100, True), (105, False), (110, True), (600, False), (603, True), (606, False), (1300, True), (1400, False), (2200, False)]
    df = spark.createDataFrame([(1, ms, down) for ms, down in levels], "user_id int, ms long, down boolean").withColumn("ts", F.timestamp_millis("ms"))
    got = sequence.confirmed_press(df, "down", "ts", "user_id").select(F.unix_millis("pressed_at").alias("a"), F.unix_millis("released_at").alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(110, 606)]  # the second press is too short
