"""Scalar functions, processes and profiles as queries, mostly over `events.value`."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.functions import process, sensor
from tessera.operators import gated, profile, sequence
from tessera.plans.registry import events, normals_sql, query, reflect_sql, table
from tessera.sources import golden


@query("""
WITH a AS (SELECT event_id, least(4094, 1 + (value * 40)::INT) AS adc FROM events)
SELECT event_id, adc::INT AS adc, round(1 / (1 / 298.15 + ln(10000.0 * adc / (4095 - adc) / 10000.0) / 3950.0) - 273.15, 6) AS celsius FROM a""")
def beta_temperature(spark, sf_dir):
    """F1."""
    adc = F.least(F.lit(4094), F.round(F.col("value") * 40).cast("int") + 1)
    return events(spark, sf_dir).select("event_id", adc.alias("adc"), F.round(sensor.beta_temperature(adc), 6).alias("celsius"))


@query("SELECT event_id, round(0.040875 * (4785 + 40 * value), 6) AS mn FROM events")
def force_from_position(spark, sf_dir):
    """D-22."""
    return events(spark, sf_dir).select("event_id", F.round(sensor.weight_force(F.col("value")), 6).alias("mn"))


@query("""
WITH r AS (SELECT event_id, 276 + value % 48 AS radius, 0.5 + value % 74 AS speed FROM events),
m AS (SELECT *, radius * (0.01745329::DOUBLE / (200.0::DOUBLE * 32.0 * 14.2857 / 360.0)) AS mm FROM r)
SELECT event_id, greatest(240, floor(least(mm * 1e6 / speed, 200240.0)))::BIGINT AS interval_us,
  round(mm / (greatest(240, floor(least(mm * 1e6 / speed, 200240.0))) * 1e-6), 6) AS realised FROM m""")
def step_interval(spark, sf_dir):
    """microseconds between steps at a radius and speed, and the speed that gives."""
    v = F.col("value")
    mm = sensor.mm_per_microstep(v % 48 + 276)
    us = sensor.step_interval(mm, v % 74 + 0.5)
    return events(spark, sf_dir).select("event_id", us.alias("interval_us"), F.round(sensor.realised_speed(mm, us), 6).alias("realised"))


@query("""
WITH s AS (SELECT event_id, 1 + value AS l, 5 + value % 60 AS v0, 20 + value % 50 AS v1 FROM events),
t AS (SELECT event_id, list_sum(list_transform(range(32), lambda i: 1.0 / greatest(0.5, v0 + (v1 - v0) * pow((i + 0.5) / 32, 3) * (10 - 15 * (i + 0.5) / 32 + 6 * pow((i + 0.5) / 32, 2))))) * l / 32 AS t FROM s)
SELECT event_id, round(t, 6) AS seconds FROM t""")
def quintic_profile_time(spark, sf_dir):
    """F2, F8: seconds over a blended segment."""
    v = F.col("value")
    t = sensor.segment_time(v + 1, v % 60 + 5, v % 50 + 20, F.lit(False))
    return events(spark, sf_dir).select("event_id", F.round(t, 6).alias("seconds"))


@query("""
SELECT event_id, round(value * (200.0::DOUBLE * 32.0 * 14.2857 / 360.0))::BIGINT AS microsteps, round((300 + value) * 0.01745329::DOUBLE, 6) AS mm_per_degree,
  round(greatest(180.0, value * value * (0.06 * 6.2832 / 2.0)), 6) AS wavelength,
  CASE WHEN event_id % 6 < 4 THEN [32.0, 26.0, 41.0, 29.0][event_id % 6 + 1]::DOUBLE END AS block_mean FROM events""")
def angles_and_blocks(spark, sf_dir):
    """F3, F5, F16, F17."""
    v = F.col("value")
    return events(spark, sf_dir).select(
        "event_id", sensor.to_microsteps(v).alias("microsteps"), F.round(sensor.mm_per_degree(sensor.effective_radius(v)), 6).alias("mm_per_degree"),
        F.round(sensor.drift_wavelength(v), 6).alias("wavelength"), sensor.block_mean(F.col("event_id") % 6).alias("block_mean"),
    )


@query("""
WITH m AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, value FROM events)
SELECT event_id, ms % 2200 < 1200 AND ms % 2200 % 400 < 150 AS lit, round(pow(0.5 - 0.5 * cos(2 * pi() * (ms % 4000) / 4000), 2), 6) AS level,
  ms % 500 < floor(least(100, value) * 5) AS heating FROM m""")
def patterns(spark, sf_dir):
    """blink, breathing and slow PWM by the clock."""
    ms = F.unix_millis("ts")
    return events(spark, sf_dir).select(
        "event_id", sensor.blink(ms, 3, 150, 250, 1000).alias("lit"), F.round(sensor.breathing(ms, 4000), 6).alias("level"),
        sensor.slow_pwm(ms, F.least(F.col("value"), F.lit(100.0))).alias("heating"),
    )


@query("""
SELECT i::INT AS i, floor(1000 * greatest(0, sin(i * pi() / 16)))::INT AS a, floor(1000 * greatest(0, -sin(i * pi() / 16)))::INT AS b,
  floor(1000 * greatest(0, cos(i * pi() / 16)))::INT AS c, floor(1000 * greatest(0, -cos(i * pi() / 16)))::INT AS d FROM range(32) r(i)""")
def sine_table(spark, sf_dir):
    """F12."""
    t = sensor.sine_table(F.col("id"), 1000.0)
    return spark.range(32).select(F.col("id").cast("int").alias("i"), *[t[k].alias(c) for k, c in enumerate("abcd")])


@query("""
SELECT event_id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(regexp_extract_all(hex(encode(props)), '..'), lambda h: ('0x' || h)::BIGINT)),
  lambda h, b: (xor(h, b) * 16777619) & 4294967295) AS checksum FROM events""")
def fnv_checksum(spark, sf_dir):
    """checksums of the properties."""
    return events(spark, sf_dir).select("event_id", sensor.fnv1a(F.col("props")).alias("checksum"))


@query("""
WITH RECURSIVE x AS (
  SELECT k, (4096 + k * 2654435761) % 4294967296 AS s, 0 AS i FROM range(200) r(k)
  UNION ALL
  SELECT k, xor(xor(xor(s, (s << 13) & 4294967295), xor(s, (s << 13) & 4294967295) >> 17), (xor(xor(s, (s << 13) & 4294967295), xor(s, (s << 13) & 4294967295) >> 17) << 5) & 4294967295), i + 1 FROM x WHERE i < 5)
SELECT k AS session_id, i::INT AS i, s AS state, (s >> 8) / 16777216.0 AS u FROM x WHERE i > 0""")
def xorshift_draws(spark, sf_dir):
    """R1, R2, F2 seeds: the first draws of 200 seeds."""
    states = process.xorshift_states(F.col("seed"), 5)
    rows = golden.seeds(spark).select("session_id", F.posexplode(states).alias("i", "state"))
    return rows.select("session_id", (F.col("i") + 1).alias("i"), "state", process.uniform(F.col("state")).alias("u"))


@query("""
WITH RECURSIVE n AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, (value - 50) / 10 AS e FROM events),
p AS (
  SELECT user_id, 0::BIGINT AS k, 32.0::DOUBLE AS x FROM n WHERE k = 1
  UNION ALL
  SELECT p.user_id, n.k, 70 - abs(((y.y - 20) % 100 + 100) % 100 - 50) FROM p JOIN n ON n.user_id = p.user_id AND n.k = p.k + 1,
    LATERAL (SELECT 32 + (p.x - 32) * exp(-1.0 / 6) + n.e * (8 * sqrt(1 - exp(-1.0 / 6) * exp(-1.0 / 6))) AS y) y)
SELECT user_id, k, round(x, 6) AS x FROM p WHERE k > 0""")
def ou_reflect_path(spark, sf_dir):
    """A bounded mean-reverting path for each user, driven by the readings: a fold, so that a history is never in one place."""
    noise = (F.col("value") - 50) / 10
    out = gated.ou_steps(events(spark, sf_dir).select("event_id", "user_id", "ts", noise.alias("noise")), 32.0, 8.0, 6.0, 20.0, 70.0)
    return out.select("user_id", "k", F.round("x", 6).alias("x"))


def _walk_sql(z: str, x: str, mean: float, sigma: float, tau: float, low: float, high: float) -> str:
    keep = f"exp(-1.0::DOUBLE / {tau})"
    return reflect_sql(f"{mean}::DOUBLE + ({x} - {mean}::DOUBLE) * {keep} + {z} * ({sigma} * sqrt(1 - {keep} * {keep}))", low, high)


@query(f"""
WITH RECURSIVE {normals_sql(200, 32)},
p AS (
  SELECT session_id, 0 AS k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c, ln(32.0::DOUBLE) AS l, 3200::BIGINT AS w FROM z WHERE k = 1
  UNION ALL
  SELECT p.session_id, z.k, {_walk_sql("z", "a", 0.0, 0.5, 16.0, -3.0, 3.0)}, {_walk_sql("z", "b", 0.0, 0.5, 4.0, -3.0, 3.0)}, {_walk_sql("z", "c", 0.0, 0.5, 1.0, -3.0, 3.0)},
    {_walk_sql("z", "l", math.log(32.0), 0.25, 6.0, math.log(20.0), math.log(70.0))},
    7000 - abs(((3200 + (((w - 3200) * 55474) >> 16) + ((round(z * 65536)::BIGINT * 800) >> 16) - 2000) % 10000 + 10000) % 10000 - 5000)
  FROM p JOIN z ON z.session_id = p.session_id AND z.k = p.k + 1)
SELECT session_id, (k - 1)::INT AS k, round(exp(l), 5) AS log_path, w AS whole, round(a + b + c, 5) AS cascade FROM p WHERE k > 0""")
def process_variants(spark, sf_dir):
    """R3, D-1, D-2, D-18: log, whole-number and cascaded paths from the seeded generator's own normal deviates."""
    rows = golden.seeds(spark).withColumn("states", process.xorshift_states(F.col("seed"), 64)).withColumn("z", process.normals(F.col("states")))
    slow, mid, fast = (process.ou_path(F.col("z"), 0.0, s, t, -3.0, 3.0) for t, s in ((16.0, 0.5), (4.0, 0.5), (1.0, 0.5)))
    whole = process.integer_ou_path(F.transform("z", lambda v: F.round(v * 65536).cast("long")), 3200, 55474, 800, 2000, 7000)
    return rows.select("session_id", F.posexplode(F.arrays_zip(process.log_ou_path(F.col("z"), 32.0, 0.25, 6.0, 20.0, 70.0).alias("log_path"), whole.alias("whole"), process.cascade([slow, mid, fast]).alias("cascade"))).alias("k", "x")).select(
        "session_id", "k", F.round("x.log_path", 5).alias("log_path"), "x.whole", F.round("x.cascade", 5).alias("cascade"),
    )


@query("""
WITH a AS (SELECT event_id, value % 44 AS d FROM events)
SELECT event_id, round(CASE WHEN d <= 19 THEN 0 WHEN d <= 26 THEN 2.67 * (1 - cos(pi() * (d - 19) / 7)) / 2 WHEN d <= 34 THEN 2.67 + 9.33 * (1 - cos(pi() * (d - 26) / 8)) / 2 ELSE 12 END, 6) AS height,
  round(CASE WHEN d <= 19 THEN 400 WHEN d <= 26 THEN 200 * (1 + cos(pi() * (d - 19) / 7)) ELSE 0 END, 6) AS force,
  round(CASE WHEN d <= 19 THEN 400 WHEN d <= 26 THEN 400 * (26 - d) / 7 ELSE 0 END, 6) AS linear_force FROM a""")
def rail(spark, sf_dir):
    """D-20, D-21: height and force over an angle, by both force laws."""
    d = F.col("value") % 44
    return events(spark, sf_dir).select("event_id", F.round(sensor.rail_height(d), 6).alias("height"), F.round(sensor.contact_force(d), 6).alias("force"), F.round(sensor.contact_force(d, "linear"), 6).alias("linear_force"))


@query("""
WITH p AS (SELECT p_partkey, p_size::DOUBLE AS x FROM part)
SELECT p_partkey, round(160 * sin(radians(x / 10)), 6) AS hinge, round(400 / (5 + x / 50), 6) AS stiffness, round((5 + x / 50) / 2.67, 6) AS ramp,
  round(5.1 - x / 100 * 0.9, 6) AS volt, CASE WHEN 5.1 - x / 100 * 0.9 >= 4.75 THEN 'ok' ELSE 'brown-out' END AS verdict,
  CASE WHEN 4.8 + x / 50 < 5 THEN 'fail' WHEN 4.8 + x / 50 < 5.5 THEN 'warn' ELSE 'good' END AS wear,
  round(22 + 25 / (50 + x) * 40, 6) AS ceiling, round((2 + x / 50) * 9.81 * 0.1 / 0.3, 6) AS tip FROM p""")
def bench_formulas(spark, sf_dir):
    """D-30, D-32, D-33, D-34, D-37, D-43 over the parts' sizes."""
    x = F.col("p_size").cast("double")
    k, ramp = sensor.stiffness(x / 50 + 5)
    volt, verdict = sensor.cable_verdict(F.lit(5.1), x / 100, F.lit(0.9))
    tip, _ = sensor.tip_over(x / 50 + 2, F.lit(0.1), F.lit(0.3))
    r6 = lambda c, n: F.round(c, 6).alias(n)
    return table(spark, sf_dir, "part").select(
        "p_partkey", r6(sensor.hinge_force_error(x / 10), "hinge"), r6(k, "stiffness"), r6(ramp, "ramp"), r6(volt, "volt"), verdict.alias("verdict"),
        sensor.wear_band(x / 50 + 4.8).alias("wear"), r6(sensor.heater_ceiling(F.lit(5.0), x + 50, F.lit(40.0), F.lit(22.0)), "ceiling"), r6(tip, "tip"),
    )


_BLEND = "list_transform(range(32), lambda i: pow((i + 0.5::DOUBLE) / 32, 3) * (10 - 15 * ((i + 0.5::DOUBLE) / 32) + 6 * pow((i + 0.5::DOUBLE) / 32, 2)))"


def _seconds_sql(length: str, v0: str, v1: str) -> str:
    """F8 in SQL; q: the list of the blend's 32 points."""
    return f"list_sum(list_transform(q, lambda b: 1 / greatest(0.5::DOUBLE, {v0} + ({v1} - {v0}) * b))) * ({length}) / 32"


@query(f"""
WITH RECURSIVE e AS (
  SELECT event_id, value % 50 + 20 AS cruise, value % 2 + 0.6::DOUBLE AS ramp, event_id % 7 = 0 AS graze, 300 * 0.01745329::DOUBLE AS k,
    CASE WHEN event_id % 2 = 0 THEN 43.0::DOUBLE ELSE -38.0::DOUBLE END AS start, {_BLEND} AS q FROM events),
b AS (
  SELECT event_id, 0 AS n, 5.0::DOUBLE AS low, 70.0::DOUBLE AS high FROM e
  UNION ALL
  SELECT b.event_id, n + 1, CASE WHEN {_seconds_sql("7 * k", "(low + high) / 2", "cruise")} > ramp THEN (low + high) / 2 ELSE low END,
    CASE WHEN {_seconds_sql("7 * k", "(low + high) / 2", "cruise")} > ramp THEN high ELSE (low + high) / 2 END
  FROM b JOIN e ON e.event_id = b.event_id WHERE n < 20),
v AS (
  SELECT e.*, CASE WHEN ramp >= {_seconds_sql("7 * k", "5.0::DOUBLE", "cruise")} THEN 5.0::DOUBLE WHEN ramp <= {_seconds_sql("7 * k", "70.0::DOUBLE", "cruise")} THEN 70.0::DOUBLE ELSE (low + high) / 2 END AS entry,
    sign(start) AS side FROM e JOIN b ON e.event_id = b.event_id AND n = 20),
a AS (
  SELECT *, abs(side * 19 - start) * k AS c0, abs(-side * 19 - start) * k AS c1, abs(side * 26 - start) * k AS t0, abs(-side * 26 - start) * k AS t1,
    abs(-side * CASE WHEN graze THEN 22.5::DOUBLE ELSE 38.0::DOUBLE END - start) * k AS far, (5625 - 36) / 400.0::DOUBLE AS slow, (5625 - entry * entry) / 400 AS fast FROM v),
s AS (
  SELECT event_id, entry, q, CASE WHEN NOT graze THEN t1 END AS air, unnest(list_concat(
    CASE WHEN slow + fast >= t0 THEN [[0, t0, 6, entry, 0]] ELSE [[0, slow, 6, 75, 0], [slow, t0 - fast, 75, 75, 1], [t0 - fast, t0, 75, entry, 0]] END,
    [[t0, c0, entry, cruise, 0], [c0, c1, cruise, cruise, 1]],
    CASE WHEN graze THEN [[c1, far, cruise, 6, 0]]
      WHEN slow + fast >= far - t1 THEN [[c1, t1, cruise, entry, 0], [t1, far, entry, 6, 0]]
      ELSE [[c1, t1, cruise, entry, 0], [t1, t1 + fast, entry, 75, 0], [t1 + fast, far - slow, 75, 75, 1], [far - slow, far, 75, 6, 0]] END)::DOUBLE[][]) AS g FROM a),
x AS (
  SELECT event_id, entry, CASE WHEN g[5] = 1 THEN (g[2] - g[1]) / greatest(0.5::DOUBLE, g[3]) ELSE {_seconds_sql("g[2] - g[1]", "g[3]", "g[4]")} END AS t,
    CASE WHEN air IS NULL OR g[2] - greatest(g[1], air) <= 0.01 THEN 0 WHEN g[5] = 1 THEN (g[2] - greatest(g[1], air)) / greatest(0.5::DOUBLE, g[3])
      ELSE {_seconds_sql("g[2] - greatest(g[1], air)", "g[3]", "g[4]")} END AS late FROM s WHERE g[2] > g[1] + 0.01)
SELECT event_id, count(*)::INT AS n_segments, round(sum(t), 6) AS seconds, round(sum(late), 6) AS air_s, round(any_value(entry), 6) AS entry FROM x GROUP BY event_id""")
def stroke_profiles(spark, sf_dir):
    """Stroke profiles with entry speeds solved for a ramp time; segments, time and air time."""
    v = F.col("value")
    rows = events(spark, sf_dir).select("event_id", (v % 50 + 20).alias("cruise"), (v % 2 + 0.6).alias("ramp_s"), F.when(F.col("event_id") % 2 == 0, 43.0).otherwise(-38.0).alias("from_deg"), (F.col("event_id") % 7 == 0).alias("graze"), F.lit(300.0).alias("radius"))
    to = F.when(F.col("graze"), 22.5).otherwise(38.0) * F.when(F.col("from_deg") >= 0, -1.0).otherwise(1.0)
    rows = profile.with_stroke(rows.withColumn("to_deg", to))
    return rows.select("event_id", F.size("segments").alias("n_segments"), F.round(profile.plan_time(F.col("segments")), 6).alias("seconds"), F.round(profile.air_time(F.col("segments"), F.col("air_from")), 6).alias("air_s"), F.round("entry", 6).alias("entry"))


@query("""
WITH d AS (SELECT event_id, 1 + value AS d FROM events), r AS (SELECT *, least(0.2 * d, 20) AS r FROM d)
SELECT event_id, CASE WHEN d <= 2 * r + 0.5 THEN 2 ELSE 3 END AS n_segments, round(d, 6) AS length FROM r""")
def simple_moves(spark, sf_dir):
    """Ramp, cruise, ramp; two ramps where there is no room for a cruise."""
    rows = events(spark, sf_dir).select("event_id", profile.simple_move(F.col("value") + 1, F.lit(26.0)).alias("s"))
    return rows.select("event_id", F.size("s").alias("n_segments"), F.round(F.element_at("s", -1)["s1"], 6).alias("length"))


@query("""
WITH m AS (SELECT event_id, value % 40 + 1 AS d, 300 * (0.01745329::DOUBLE / (200.0::DOUBLE * 32.0 * 14.2857 / 360.0)) AS mm FROM events),
r AS (SELECT *, least(d * 0.2::DOUBLE, 20.0::DOUBLE) AS r FROM m),
t AS (SELECT *, unnest(range(1, 1 + greatest(1, round(d / mm)::BIGINT))) * mm AS s FROM r),
g AS (
  SELECT *, CASE WHEN d <= r * 2 + 0.5::DOUBLE THEN CASE WHEN s <= d * 0.5::DOUBLE THEN [0, d * 0.5::DOUBLE, 6, 26] ELSE [d * 0.5::DOUBLE, d, 26, 6] END
    WHEN s <= r THEN [0, r, 6, 26] WHEN s <= d - r THEN [r, d - r, 26, 26] ELSE [d - r, d, 26, 6] END AS g FROM t),
u AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (s - g[1]) / (g[2] - g[1]))) AS u FROM g),
v AS (SELECT *, greatest(0.5::DOUBLE, least(75.0::DOUBLE, g[3] + (g[4] - g[3]) * (u * u * u * (10 + u * (u * 6 - 15))))) AS v FROM u),
i AS (SELECT event_id, mm, greatest(240, floor(least(mm * 1e6 / v, 200240.0::DOUBLE))::BIGINT) AS us FROM v)
SELECT event_id, count(*) AS steps, round(sum(us)::DOUBLE / 1e6, 6) AS seconds, round(max(mm / (us * 1e-6)), 6) AS fastest, min(us) AS least_us FROM i GROUP BY event_id""")
def expanded_steps(spark, sf_dir):
    """Every step of every event's move, summed up: the generator is an explode, the fold partial."""
    rows = events(spark, sf_dir).select("event_id", profile.simple_move(F.col("value") % 40 + 1, F.lit(26.0)).alias("segments"), F.lit(300.0).alias("radius"))
    # before a row becomes a thousand; a number that is told isn't lowered for small rows, so a task's share doesn't grow
    steps = profile.expand(rows.repartition(profile.tasks(rows), "event_id"), "segments", "radius")
    return steps.groupBy("event_id").agg(F.count("*").alias("steps"), F.round(F.sum("interval_us") / 1e6, 6).alias("seconds"), F.round(F.max("realised"), 6).alias("fastest"), F.min("interval_us").alias("least_us"))


@query("""
SELECT event_id, round(CASE WHEN u < 8 THEN u ELSE u + 2 END, 6) AS at FROM (SELECT event_id, (value % 1) * 18 AS u FROM events)""")
def interval_draw(spark, sf_dir):
    """D-4: a place drawn from [0, 20] without (8, 10), by length."""
    whole = F.array(F.struct(F.lit(0.0).alias("lo"), F.lit(20.0).alias("hi")))
    free = sequence.subtract_interval(whole, F.lit(8.0), F.lit(10.0))
    return events(spark, sf_dir).select("event_id", F.round(sequence.draw_from_intervals(free, F.col("value") % 1), 6).alias("at"))


def _without_sql(free: str, centre: str) -> str:
    """D-4 in SQL: a list of [low, high] without the places nearer to the centre than 6."""
    cut = f"list_filter(flatten(list_transform({free}, lambda i: [[i[1], least(i[2], {centre} - 6)], [greatest(i[1], {centre} + 6), i[2]]])), lambda i: i[2] > i[1])"
    return f"CASE WHEN {centre} IS NULL THEN {free} ELSE {cut} END"


def _drawn_sql(free: str) -> str:
    length = lambda k: f"coalesce({free}[{k}][2] - {free}[{k}][1], 0)"
    before = lambda k: " + ".join(["0", *(length(j) for j in range(1, k))])
    at = f"u * list_sum(list_transform({free}, lambda i: i[2] - i[1]))"
    return "CASE " + " ".join(f"WHEN {at} <= {before(k + 1)} THEN {free}[{k}][1] + ({at} - ({before(k)}))" for k in range(1, 5)) + " END"


@query(f"""
WITH h AS (SELECT event_id, value % 20 AS cur, value % 1 AS u, lag(value % 20, 1) OVER w AS h1, lag(value % 20, 2) OVER w AS h2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
w AS (SELECT *, [[greatest(cur - 12, -24.0), least(cur + 12, 24.0)]]::DOUBLE[][] AS near, [[greatest(cur - 16, -24.0), least(cur + 16, 24.0)]]::DOUBLE[][] AS wide FROM h),
a AS (SELECT *, {_without_sql("near", "cur")} AS n0, {_without_sql("wide", "cur")} AS w0 FROM w),
b AS (SELECT *, {_without_sql("n0", "h1")} AS n1, {_without_sql("w0", "h1")} AS w1 FROM a),
c AS (SELECT *, {_without_sql("n1", "h2")} AS n2 FROM b)
SELECT event_id, cur, h1, h2, round(coalesce({_drawn_sql("n2")}, {_drawn_sql("n1")}, {_drawn_sql("w1")}, cur), 6) AS radius FROM c""")
def relaxed_radius(spark, sf_dir):
    """D-5: radii drawn by a hierarchy of rules."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    cur = F.col("value") % 20
    rows = events(spark, sf_dir).select("event_id", cur.alias("cur"), F.lag(cur, 1).over(w).alias("h1"), F.lag(cur, 2).over(w).alias("h2"), (F.col("value") % 1).alias("u"))
    return rows.select("event_id", "cur", "h1", "h2", F.round(sequence.draw_radius(F.col("u"), F.col("cur"), [F.col("h1"), F.col("h2")], -24.0, 24.0, 6.0, 12.0), 6).alias("radius"))


@query("""
WITH p AS (SELECT p_partkey, 4 + p_size * 0.25::DOUBLE AS d, 0.5::DOUBLE + p_size / 100 AS o, p_size * 1.0::DOUBLE - 20 AS deg FROM part),
m AS (SELECT *, [['contact', 247 / (d * 14.2857::DOUBLE + 48)], ['taper', 247 / (d * 14.2857::DOUBLE + 57)], ['lift', 247 / (d * 14.2857::DOUBLE + 66)], ['plateau', 247 / (d * 14.2857::DOUBLE + 32)]] AS r,
  pow(o / 0.75::DOUBLE, 2) * 23.0::DOUBLE * 300 / 70 AS v FROM p)
SELECT p_partkey, round((d * 14.2857::DOUBLE + 66) * 1.4::DOUBLE / (0.07::DOUBLE * 9.81::DOUBLE), 6) AS grams, round((d * 14.2857::DOUBLE + 66) * 1.4::DOUBLE / (0.07::DOUBLE * 9.81::DOUBLE) / 3.85::DOUBLE, 6) AS rod_mm,
  'lift' AS regime, round(247 / (d * 14.2857::DOUBLE + 66), 6) AS margin, round(v, 6) AS speed, CASE WHEN v < 85 THEN 'slow' WHEN v <= 115 THEN 'in band' ELSE 'fast' END AS band,
  round(radians(43 - deg) * 300 / v, 6) AS retract_s FROM m""")
def counterweights(spark, sf_dir):
    """D-26, D-27: counterweight and margin by the detent, retraction by the orifice; a part's size stands for each."""
    size = F.col("p_size").cast("double")
    detent, orifice = size * 0.25 + 4, size / 100 + 0.5
    grams, rod = sensor.counterweight(detent)
    speed, band = sensor.tip_speed(orifice)
    least = F.array_min(sensor.safety_margins(detent))
    r6 = lambda c, n: F.round(c, 6).alias(n)
    return table(spark, sf_dir, "part").select(
        "p_partkey", r6(grams, "grams"), r6(rod, "rod_mm"), least["regime"].alias("regime"), r6(least["margin"], "margin"), r6(speed, "speed"), band.alias("band"),
        r6(sensor.retract_seconds(size - 20, speed), "retract_s"),
    )


@query("""
SELECT event_id, round(-sign(value - 50 + 1e-9) * (20.75::DOUBLE + value % 2), 6) AS far, round(sign(value - 50 + 1e-9) * (20.75::DOUBLE + value % 2), 6) AS same FROM events""")
def graze_turns(spark, sf_dir):
    """D-7: where a grazing stroke turns, by either model."""
    start, degrees = F.col("value") - 50 + 1e-9, F.col("value") % 2 + 20.75
    return events(spark, sf_dir).select("event_id", *[F.round(profile.graze_turn(start, degrees, m), 6).alias(m) for m in ("far", "same")])
