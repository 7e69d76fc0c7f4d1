"""Planning rules, schedules and trends as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import process
from tessera.operators import sequence, session
from tessera.plans.registry import ORDER, events, normals_sql, query, reflect_sql
from tessera.sources import golden


def _by_user():
    return Window.partitionBy("user_id").orderBy(*ORDER)


@query("""
WITH i AS (SELECT *, abs(value % 60 - 30) <= 26 AND value >= 30 AND event_type <> 'view' AS hit FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, hit ORDER BY ts, event_id) AS island FROM i),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, hit, island ORDER BY ts, event_id) AS run FROM r)
SELECT event_id, user_id FROM n WHERE hit AND run = 3""")
def stall_gate(spark, sf_dir):
    """Fires once, at the third high in a row while the gate is open."""
    hit = (F.abs(F.col("value") % 60 - 30) <= 26) & (F.col("value") >= 30) & (F.col("event_type") != "view")
    return sequence.islands(events(spark, sf_dir), hit, "user_id", ORDER).filter("hit AND run = 3").select("event_id", "user_id")


@query("""
WITH b AS (SELECT user_id, arg_min(value, (ts, event_id)) AS boot FROM events GROUP BY 1)
SELECT event_id, boot <= 24 AND value < 38 AS permitted FROM events JOIN b USING (user_id)""")
def heater_permission(spark, sf_dir):
    """By the reading at boot: the device's first row, carried to the others by a window."""
    boot = F.first("value").over(_by_user().rowsBetween(Window.unboundedPreceding, 0))
    return events(spark, sf_dir).select("event_id", ((boot <= 24) & (F.col("value") < 38)).alias("permitted"))


@query("""
SELECT event_id, user_id, round(value * 1000)::BIGINT - 50000 AS error FROM events WHERE abs(round(value * 1000)::BIGINT - 50000) > 960""")
def drift_tolerance(spark, sf_dir):
    """What is out of its tolerance."""
    error = F.round(F.col("value") * 1000).cast("long") - 50_000
    return events(spark, sf_dir).select("event_id", "user_id", error.alias("error")).filter(F.abs("error") > 960)


@query("""
WITH s AS (SELECT user_id, min(epoch_us(ts)) AS t0 FROM events GROUP BY 1), d AS (SELECT user_id, k, t0 + k * 86400000000 * 5 AS due FROM s, range(5) r(k))
SELECT user_id, k::INT AS k, due, (SELECT min(epoch_us(ts)) FROM events e WHERE e.user_id = d.user_id AND epoch_us(ts) >= due) AS at FROM d""")
def scheduled_visits(spark, sf_dir):
    """Visits due at fixed times, each at the next event that is due or later."""
    us = F.unix_micros("ts")
    rows = events(spark, sf_dir).select("user_id", us.alias("us"), "event_id")
    first = rows.groupBy("user_id").agg(F.min("us").alias("t0"))
    due = first.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"), "t0").withColumn("due", F.col("t0") + F.col("k") * 86_400_000_000 * 5)
    # as-of by a union: each due time looks ahead to the nearest event of its key
    both = rows.select("user_id", "us", F.lit(None).cast("int").alias("k"), F.lit(1).alias("kind")).union(due.select("user_id", "due", "k", F.lit(0)))
    ahead = Window.partitionBy("user_id").orderBy("us", "kind").rowsBetween(0, Window.unboundedFollowing)
    return both.withColumn("at", F.first(F.when(F.col("kind") == 1, F.col("us")), ignorenulls=True).over(ahead)).filter("kind = 0").select("user_id", "k", F.col("us").alias("due"), "at")


@query("""
SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, arg_max(value, (ts, event_id)) AS value, count(*) AS events, count(*) FILTER (event_type = 'error') AS faults FROM events GROUP BY 1""")
def latest_status(spark, sf_dir):
    """Each device's latest state."""
    last = lambda c: F.max_by(c, F.struct(*ORDER)).alias(c if c == "value" else "state")
    return events(spark, sf_dir).groupBy("user_id").agg(last("event_type"), last("value"), F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("faults"))


@query("""
SELECT event_id, round(greatest(0, least(12, (0.2 * (value % 20) + value % 5 + 1.5 - 0.4) / 0.5)), 6) AS cap,
  round(1.5 + (value % 1) * 4, 6) AS gap, round(least(1, (event_id % 900) / 50.0, (900 - event_id % 900) / 60.0), 6) AS envelope,
  CASE WHEN event_id % 225 = 100 THEN 8 + (value % 1) * 12 END AS parking FROM events""")
def planning_rules(spark, sf_dir):
    """D-6, D-8, D-9, D-10: the cap on a jump by contact and gap, a uniform gap, the session's envelope, one parking a block."""
    v, t = F.col("value"), F.col("event_id") % 900
    cap = F.greatest(F.lit(0.0), F.least(F.lit(12.0), ((v % 20) * 0.2 + v % 5 + 1.5 - 0.4) / 0.5))
    return events(spark, sf_dir).select(
        "event_id", F.round(cap, 6).alias("cap"), F.round((v % 1) * 4 + 1.5, 6).alias("gap"),
        F.round(F.least(F.lit(1.0), t / 50.0, (900 - t) / 60.0), 6).alias("envelope"),
        F.when(F.col("event_id") % 225 == 100, (v % 1) * 12 + 8).alias("parking"),
    )


@query("""
SELECT user_id, count(*) FILTER (abs(value - 50) > 30) AS misses, CASE WHEN count(*) FILTER (abs(value - 50) > 30) = 0 THEN 'ok' WHEN count(*) FILTER (abs(value - 50) > 30) = 1 THEN 'retry' ELSE 'fault' END AS verdict,
  round(max(abs(value - 50)), 6) AS worst FROM events GROUP BY 1""")
def integrity_visits(spark, sf_dir):
    """All visits' errors by device, and a verdict by how many missed; integrity_retries is T12 and T13."""
    rows = events(spark, sf_dir).select("user_id", F.abs(F.col("value") - 50).alias("err"))
    misses = F.count_if(F.col("err") > 30)
    return rows.groupBy("user_id").agg(misses.alias("misses"), F.when(misses == 0, "ok").when(misses == 1, "retry").otherwise("fault").alias("verdict"), F.round(F.max("err"), 6).alias("worst"))


@query()
def score_against_figures(spark, sf_dir):
    """D-19: how a session's score goes with its figures."""
    own = session.report(session.simulate(golden.seeds(spark)))
    score = events(spark, sf_dir).groupBy((F.col("user_id") % 200).alias("session_id")).agg(F.avg("value").alias("score"))
    j = own.join(score, "session_id")
    return j.agg(*[F.corr("score", c).alias(c) for c in ("strokes", "grazes", "path_mm", "v_high", "gap_high")])


_TIMES = "((({0})::HUGEINT * {1}) & 4294967295)::BIGINT"
_TURN = "((({0} << {1}) & 4294967295) | ({0} >> {2}))"


def _mixed_sql(x: str) -> str:
    a = f"(({x} + 2654435769) & 4294967295)"
    b = _TIMES.format(f"xor({a}, {a} >> 16)", 2246822507)
    c = _TIMES.format(f"xor({b}, {b} >> 13)", 3266489909)
    return f"xor({c}, {c} >> 16)"


@query(f"""
WITH RECURSIVE s AS (SELECT k AS session_id, (4096 + k * 2654435761) % 4294967296 AS seed FROM range(200) r(k)),
f AS (SELECT session_id, {", ".join(_mixed_sql(f"((seed + {k}) & 4294967295)") + f" AS s{k}" for k in range(4))} FROM s),
x AS (
  SELECT session_id, -1 AS i, NULL::BIGINT AS value, s0, s1, s2, s3 FROM f
  UNION ALL
  SELECT session_id, i + 1, ({_TURN.format("((s1 * 5) & 4294967295)", 7, 25)} * 9) & 4294967295, xor(s0, xor(s3, s1)), xor(s1, xor(s2, s0)),
    xor(xor(s2, s0), (s1 << 9) & 4294967295), {_TURN.format("xor(s3, s1)", 11, 21)} FROM x WHERE i < 7)
SELECT session_id, i::INT AS i, value FROM x WHERE i >= 0""")
def generators(spark, sf_dir):
    """D-3: numbers of xoshiro128** from states that SplitMix makes of the seeds."""
    four = F.array(*[process.splitmix32((F.col("seed") + k).bitwiseAND(F.lit(process.MASK))) for k in range(4)])
    return golden.seeds(spark).select("session_id", F.posexplode(process.xoshiro128(four, 8)).alias("i", "value"))


@query(f"""
WITH RECURSIVE {normals_sql(10_000, 50)},
p AS (
  SELECT session_id, 0 AS k, 32.0::DOUBLE AS x FROM z WHERE k = 1
  UNION ALL
  SELECT p.session_id, z.k, {reflect_sql("32 + (p.x - 32) * exp(-1.0::DOUBLE / 6) + z.z * 10 * (8 * sqrt(1 - exp(-1.0::DOUBLE / 6) * exp(-1.0::DOUBLE / 6)))", 20.0, 70.0)}
  FROM p JOIN z ON z.session_id = p.session_id AND z.k = p.k + 1)
SELECT round(min(x), 6) AS least, round(max(x), 6) AS most, round(avg(x), 6) AS mean, count(*) AS n, bool_and(x BETWEEN 20 AND 70) AS in_band FROM p WHERE k > 0""")
def ou_stress(spark, sf_dir):
    """A6, D-13: extremes and mean of a million steps under ten times the noise: none leaves its band."""
    # a column of their own: within the lambda that pairs them up, states would be worked out for each pair
    rows = golden.seeds(spark, 10_000).repartition("session_id").withColumn("states", process.xorshift_states(F.col("seed"), 100))
    z = F.transform(process.normals(F.col("states")), lambda v: v * 10)
    x = rows.select(F.explode(process.ou_path(z, 32.0, 8.0, 6.0, 20.0, 70.0)).alias("x"))
    r6 = lambda c, n: F.round(c, 6).alias(n)
    return x.agg(r6(F.min("x"), "least"), r6(F.max("x"), "most"), r6(F.avg("x"), "mean"), F.count("*").alias("n"), F.bool_and((F.col("x") >= 20) & (F.col("x") <= 70)).alias("in_band"))
