"""Speeds along a way, ramps of a session, parkings and bench verdicts, each over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import ramps, sensor
from tessera.operators import profile
from tessera.plans.function_queries import _BLEND, _seconds_sql
from tessera.plans.registry import ORDER, events, query, table
from tessera.sources import golden


@query("""
WITH e AS (SELECT event_id, value % 40 + 5 AS d, 60 + value % 12 AS top, (event_id % 7)::DOUBLE AS phase FROM events),
r AS (SELECT *, least(d * 0.2::DOUBLE, 20.0::DOUBLE) AS r FROM e),
p AS (SELECT *, k, d * k / 8 AS s FROM r, range(1, 9) t(k)),
g AS (SELECT *, CASE WHEN d <= r * 2 + 0.5::DOUBLE THEN CASE WHEN s <= d * 0.5::DOUBLE THEN [0, d * 0.5::DOUBLE, 6, top] ELSE [d * 0.5::DOUBLE, d, top, 6] END
  WHEN s <= r THEN [0, r, 6, top] WHEN s <= d - r THEN [r, d - r, top, top] ELSE [d - r, d, top, 6] END AS g FROM p),
u AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (s - g[1]) / (g[2] - g[1]))) AS u FROM g),
v AS (SELECT *, g[3] + (g[4] - g[3]) * (u * u * u * (10 + u * (u * 6 - 15))) AS v, sin((s - d * 0.25) * (2 * 3.141592653589793 / 20) + phase) * 0.06 + 1 AS f FROM u)
SELECT event_id, k::INT AS k, round(greatest(0.5::DOUBLE, least(75.0::DOUBLE, CASE WHEN s >= d * 0.25 AND s <= d * 0.75 THEN greatest(20.0::DOUBLE, least(70.0::DOUBLE, v * f)) ELSE v END)), 6) AS speed FROM v""")
def drifting_speeds(spark, sf_dir):
    """the speed at eight places of each event's move, with the drift within contact and its band there."""
    d = F.col("value") % 40 + 5
    rows = events(spark, sf_dir).select("event_id", d.alias("d"), (F.col("event_id") % 7).cast("double").alias("phase"), profile.simple_move(d, F.col("value") % 12 + 60).alias("segments"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(8)))).withColumn("s", F.col("d") * F.col("k") / 8)
    low, high = F.col("d") * 0.25, F.col("d") * 0.75
    drift = ramps.drift_factor(F.col("s"), low, 0.06, 20.0, F.col("phase"))
    return rows.select("event_id", "k", F.round(profile.speed_at(F.col("segments"), F.col("s"), drift, low, high), 6).alias("speed"))


@query(f"""
WITH e AS (SELECT event_id, value + 1 AS d, 3 + value % 40 AS v, {_BLEND} AS q FROM events), r AS (SELECT *, least(0.2::DOUBLE * d, 20.0::DOUBLE) AS r, least(6.0::DOUBLE, v) AS slow FROM e),
s AS (SELECT event_id, q, unnest(CASE WHEN d <= 2 * r + 0.5 THEN [[0, d * 0.5, slow, v, 0, 1], [d * 0.5, d, v, slow, 0, 2]]
  ELSE [[0, r, slow, v, 0, 1], [r, d - r, v, v, 1, 2], [d - r, d, v, slow, 0, 3]] END::DOUBLE[][]) AS g FROM r)
SELECT event_id, g[6]::INT AS k, round(g[3], 6) AS v0, round(g[4], 6) AS v1, round(g[2] - g[1], 6) AS mm,
  round(CASE WHEN g[5] = 1 THEN (g[2] - g[1]) / greatest(0.5::DOUBLE, g[3]) ELSE {_seconds_sql("g[2] - g[1]", "g[3]", "g[4]")} END, 6) AS seconds FROM s WHERE g[2] > g[1] + 0.01""")
def simple_move_speeds(spark, sf_dir):
    """The ramps of each simple move: speeds at either end, length and time; slow speeds have no lower start."""
    rows = events(spark, sf_dir).select("event_id", profile.simple_move(F.col("value") + 1, F.col("value") % 40 + 3).alias("segments"))
    rows = rows.select("event_id", F.posexplode("segments").alias("k", "g"))
    seconds = profile.plan_time(F.array(F.col("g")))
    r6 = lambda c, n: F.round(c, 6).alias(n)
    return rows.select("event_id", (F.col("k") + 1).alias("k"), r6(F.col("g.v0"), "v0"), r6(F.col("g.v1"), "v1"), r6(F.col("g.s1") - F.col("g.s0"), "mm"), r6(seconds, "seconds"))


BLOCK_US = 5 * 86_400_000_000


@query(f"""
WITH o AS (SELECT user_id, event_id, ts, value, epoch_us(ts) // {BLOCK_US} AS block, (epoch_us(ts) % {BLOCK_US}) / {BLOCK_US}.0::DOUBLE AS place,
  CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) % 2 = 1 THEN -1 ELSE 1 END AS side FROM events),
w AS (SELECT *, side > 0 AND value % 1 < 0.4 AND place > 0.2 AND place < 0.8 AS wants FROM o),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, block, wants ORDER BY ts, event_id) AS nth FROM w)
SELECT user_id, block::BIGINT AS block, event_id, round(8 + (value * 10) % 1 * 12, 6) AS parked_s FROM k WHERE wants AND nth = 1""")
def block_parkings(spark, sf_dir):
    """D-8: one long parking a block and device: the first draw that wants it, at rest, in the block's middle; then no more."""
    us, v = F.unix_micros("ts"), F.col("value")
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    rows = events(spark, sf_dir).select("user_id", "event_id", "ts", "value", F.floor(us / BLOCK_US).cast("long").alias("block"), ((us % BLOCK_US) / BLOCK_US).alias("place"), F.when(F.row_number().over(w) % 2 == 1, -1).otherwise(1).alias("side"))
    wants = rows.filter((F.col("side") > 0) & (v % 1 < 0.4) & (F.col("place") > 0.2) & (F.col("place") < 0.8))
    first = wants.groupBy("user_id", "block").agg(F.min_by(F.struct("event_id", "value"), F.struct(*ORDER)).alias("x"))
    return first.select("user_id", "block", "x.event_id", F.round((F.col("x.value") * 10) % 1 * 12 + 8, 6).alias("parked_s"))


@query("""
WITH t AS (SELECT event_id, (event_id % 900)::DOUBLE AS t FROM events),
f AS (SELECT *, CASE WHEN t < 50 THEN 150 + 150 * t / 50 WHEN t > 840 THEN 300 - 150 * (t - 840) / 60 ELSE 300 END AS most FROM t)
SELECT event_id, round(CASE WHEN t < 50 THEN 0.7 - 0.55 * t / 50 WHEN t > 840 THEN 0.15 + 0.65 * (t - 840) / 60 ELSE 0.15 END, 6) AS share, round(most, 6) AS most_mn,
  round(CASE WHEN t > 840 THEN greatest(150, most - 50) ELSE 150 END, 6) AS least_mn FROM f""")
def session_ramps(spark, sf_dir):
    """D-9: the share of grazing strokes and their forces over a session's two ramps."""
    t = (F.col("event_id") % 900).cast("double")
    least, most = ramps.graze_force(t)
    return events(spark, sf_dir).select("event_id", F.round(ramps.graze_share(t), 6).alias("share"), F.round(most, 6).alias("most_mn"), F.round(least, 6).alias("least_mn"))


@query("""
WITH m AS (SELECT p_brand AS head, p_partkey, 4 + p_size * 0.16::DOUBLE AS c, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part),
h AS (SELECT head, avg(c) AS c, count(*) AS repeats FROM m WHERE k <= 3 GROUP BY head)
SELECT head, repeats, round(c, 6) AS compression, round(400 / c, 6) AS stiffness, round(c / 2.67, 6) AS ramp FROM h""")
def brush_heads(spark, sf_dir):
    """D-33: stiffness and ramp height of each head by the mean of its first three measurements."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("head"), (F.col("p_size") * 0.16 + 4).alias("c"), F.row_number().over(w).alias("k")).filter("k <= 3")
    heads = rows.groupBy("head").agg(F.avg("c").alias("c"), F.count("*").alias("repeats"))
    k, ramp = sensor.stiffness(F.col("c"))
    return heads.select("head", "repeats", F.round("c", 6).alias("compression"), F.round(k, 6).alias("stiffness"), F.round(ramp, 6).alias("ramp"))


@query("""
SELECT p_partkey, round(160 * sin(asin(p_size * 0.22 / 100)), 6) AS force_mn, CASE WHEN p_size * 0.22 <= 3.5 THEN 'excellent' WHEN p_size * 0.22 <= 5.2 THEN 'accepted' WHEN p_size * 0.22 <= 8.7 THEN 'limit' ELSE 'rejected' END AS verdict FROM part""")
def hinge_verdicts(spark, sf_dir):
    """D-32: the force error and the verdict that a hinge's measured drift over 100 mm stands for."""
    mm = F.col("p_size") * 0.22
    return table(spark, sf_dir, "part").select("p_partkey", F.round(sensor.hinge_force_error(F.degrees(F.asin(mm / 100))), 6).alias("force_mn"), ramps.drift_verdict(mm).alias("verdict"))


@query("""
WITH e AS (SELECT p_partkey, 1 + p_size / 20.0::DOUBLE AS m, (p_partkey % 23)::DOUBLE - 11 AS shift, unnest(['front', 'back', 'side']) AS edge, unnest([140.0, 60.0, 150.0]::DOUBLE[]) AS reach FROM part),
d AS (SELECT *, CASE edge WHEN 'front' THEN reach - shift WHEN 'back' THEN reach + shift ELSE reach END AS d FROM e),
f AS (SELECT *, m * 9.81 * d / 224 AS newton, degrees(atan(d / 69.1)) AS angle FROM d)
SELECT p_partkey, arg_min(edge, newton) AS edge, round(min(newton), 6) AS newton, round(arg_min(angle, newton), 6) AS angle, min(newton) >= 5 AS stands FROM f GROUP BY 1""")
def weakest_edges(spark, sf_dir):
    """D-37: force and angle that tip a stand over each of its edges; the weakest edge decides."""
    shift = (F.col("p_partkey") % 23).cast("double") - 11
    sides = F.array(*[F.struct(F.lit(n).alias("edge"), d.alias("d")) for n, d in (("front", F.lit(140.0) - shift), ("back", shift + 60.0), ("side", F.lit(150.0)))])
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 20 + 1).alias("m"), F.explode(sides).alias("x"))
    newton, _ = sensor.tip_over(F.col("m"), F.col("x.d"), F.lit(224.0))
    _, angle = sensor.tip_over(F.col("m"), F.col("x.d"), F.lit(69.1))
    rows = rows.select("p_partkey", "x.edge", newton.alias("newton"), angle.alias("angle"))
    own = rows.groupBy("p_partkey").agg(F.min_by("edge", "newton").alias("edge"), F.min("newton").alias("least"), F.min_by("angle", "newton").alias("angle"))
    return own.select("p_partkey", "edge", F.round("least", 6).alias("newton"), F.round("angle", 6).alias("angle"), (F.col("least") >= 5).alias("stands"))


@query("""
WITH s(surface, k, most) AS (VALUES ('hair', 0, 40.0), ('ferrule', 1, 43.0), ('cup', 2, 40.0), ('column', 3, 50.0)),
m AS (SELECT event_id % 4 AS k, user_id, max(18 + value * 0.25) AS reached FROM events GROUP BY 1, 2)
SELECT user_id, surface, round(reached, 6) AS reached, most::DOUBLE AS most, round(most - reached, 6) AS margin FROM m JOIN s USING (k) WHERE reached > most - 1""")
def warm_surfaces(spark, sf_dir):
    """D-42: the surfaces that came within a degree of what they may reach, or beyond: the largest reading against a limit."""
    names = F.array(*[F.lit(n) for n, _ in ramps.SURFACES])
    rows = events(spark, sf_dir).select("user_id", F.element_at(names, (F.col("event_id") % 4 + 1).cast("int")).alias("surface"), (F.col("value") * 0.25 + 18).alias("c"))
    limits = spark.createDataFrame(list(ramps.SURFACES), "surface string, most double")
    own = rows.groupBy("user_id", "surface").agg(F.max("c").alias("reached")).join(limits, "surface")
    return own.filter("reached > most - 1").select("user_id", "surface", F.round("reached", 6).alias("reached"), "most", F.round(F.col("most") - F.col("reached"), 6).alias("margin"))


def _parameters_sql() -> str:
    return ", ".join(str((s, axis, *map(float, v))) for s, axes in golden.PARAMETERS.items() for axis, v in axes.items())


@query(f"""
WITH p(param_set, axis, tau, mean, sigma, low, high) AS (VALUES {_parameters_sql()}),
e AS (SELECT value, ['velocity', 'gap', 'ramp', 'turnaround', 'graze', 'radius'][event_id % 6 + 1] AS axis FROM events)
SELECT param_set, axis, count(*) AS n, count(*) FILTER (value < low OR value > high) AS outside, round(avg((value - mean) / sigma), 6) AS mean_z, round(exp(-1 / any_value(tau)), 6) AS keep
FROM e JOIN p USING (axis) GROUP BY 1, 2""")
def axis_scores(spark, sf_dir):
    """Readings held against the parameters of the axis they stand for, in either set."""
    names = F.array(*[F.lit(a) for a in golden.FIRMWARE])
    rows = events(spark, sf_dir).select("value", F.element_at(names, (F.col("event_id") % 6 + 1).cast("int")).alias("axis"))
    met = rows.join(golden.parameters(spark), "axis")
    v = F.col("value")
    return met.groupBy("param_set", "axis").agg(
        F.count("*").alias("n"), F.count_if((v < F.col("low")) | (v > F.col("high"))).alias("outside"),
        F.round(F.avg((v - F.col("mean")) / F.col("sigma")), 6).alias("mean_z"), F.round(F.exp(F.lit(-1.0) / F.first("tau")), 6).alias("keep"),
    )
