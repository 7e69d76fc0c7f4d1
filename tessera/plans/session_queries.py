"""Simulated sessions and the state machine."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import integrity, profile, session
from tessera.plans.registry import ORDER, events, query
from tessera.sources import golden
from tessera.streaming import machine

#: Signals that the events stand for, by a rule on their ids.
SIGNALS = ("configured", "tuned", "home", "armed", "warm", "full", "parked", "stall", "unsafe", "integrity", "ferrule_sensor", "cup_sensor", "over_temperature", "brown_out", "microsteps")
SIGNALS_SQL = f"[{', '.join(map(repr, SIGNALS))}][(event_id * 7 + event_id // 10) % {len(SIGNALS)} + 1]"


def _signals(rows):
    k = (F.col("event_id") * 7 + F.floor(F.col("event_id") / 10)) % len(SIGNALS) + 1
    return rows.select("event_id", "user_id", "ts", F.element_at(F.array(*map(F.lit, SIGNALS)), k.cast("int")).alias("signal"))


@query()
def session_strokes(spark, sf_dir):
    """The strokes of 200 seeded sessions."""
    return session.simulate(golden.seeds(spark))


@query()
def session_report(spark, sf_dir):
    """A2-A4: each session's figures."""
    return session.report(session.simulate(golden.seeds(spark)))


@query()
def session_totals(spark, sf_dir):
    """A5: over all sessions, for either set of parameters."""
    both = [session.report(session.simulate(golden.seeds(spark), p)).withColumn("param_set", F.lit(p)) for p in golden.PARAMETERS]
    rows = both[0].union(both[1])
    return rows.groupBy("param_set").agg(F.min("strokes").alias("least"), F.avg("strokes").alias("mean"), F.max("strokes").alias("most"), F.max("t_final").alias("t_final"), F.avg("path_mm").alias("path_mm"))


@query(f"""
WITH RECURSIVE t(state, signal, next, fault) AS (VALUES {', '.join(map(str, golden.TRANSITIONS))}),
o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k,
  {SIGNALS_SQL} AS signal FROM events),
m AS (
  SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, 'BOOT' AS before, 'BOOT' AS state, 0 AS fault FROM o WHERE k = 1
  UNION ALL
  SELECT o.user_id, o.k, o.event_id, m.state, coalesce(t.next, m.state), CASE WHEN t.next = 'PREWARM' THEN 0 WHEN m.fault <> 0 THEN m.fault ELSE coalesce(t.fault, 0) END
  FROM m JOIN o ON o.user_id = m.user_id AND o.k = m.k + 1 LEFT JOIN t ON t.state = m.state AND t.signal = o.signal)
SELECT event_id, user_id, before AS from_state, state AS to_state, fault::INT AS fault FROM m WHERE event_id IS NOT NULL AND before <> state""")
def state_machine(spark, sf_dir):
    """The transitions of each device; the first fault stays until the next start."""
    return machine.transitions(_signals(events(spark, sf_dir))).select("event_id", "user_id", "from_state", "to_state", "fault")


@query(f"""
WITH RECURSIVE t(state, signal, next, fault) AS (VALUES {', '.join(map(str, golden.TRANSITIONS))}),
o AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_id % 11 = 0 AS told,
  ['i', 'Z', 'H', 'x'][event_id // 11 % 4 + 1] AS command, {SIGNALS_SQL} AS signal FROM events),
m AS (
  SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, 'BOOT' AS now, 0 AS fault, 0 AS sessions, 0 AS faults, NULL::BIGINT AS until, NULL::VARCHAR AS answer FROM o WHERE k = 1
  UNION ALL
  SELECT o.user_id, o.k, o.event_id, CASE WHEN w.lost THEN m.now WHEN o.told THEN w.now ELSE coalesce(t.next, w.now) END,
    CASE WHEN w.lost THEN m.fault WHEN o.told THEN w.fault WHEN t.next = 'PREWARM' THEN 0 WHEN w.fault <> 0 THEN w.fault ELSE coalesce(t.fault, 0) END,
    CASE WHEN w.lost THEN m.sessions WHEN o.told AND o.command = 'Z' THEN 0 ELSE m.sessions + coalesce(t.next = 'RUNNING', false)::INT END,
    CASE WHEN w.lost THEN m.faults WHEN o.told AND o.command = 'Z' THEN 0 ELSE m.faults + coalesce(t.next = 'FAULT', false)::INT END,
    CASE WHEN w.lost THEN m.until WHEN o.told AND o.command = 'H' THEN o.us + 21600000000 END,
    CASE WHEN w.lost OR NOT o.told THEN NULL WHEN o.command = 'H' THEN 'hangs' WHEN o.command = 'Z' THEN 'erased' WHEN o.command = 'i' THEN w.now || ' ' || m.sessions || '/' || m.faults END
  FROM m JOIN o ON o.user_id = m.user_id AND o.k = m.k + 1,
    LATERAL (SELECT coalesce(o.us < m.until, false) AS lost, CASE WHEN o.us >= m.until THEN 'BOOT' ELSE m.now END AS now, CASE WHEN o.us >= m.until THEN 0 ELSE m.fault END AS fault) w
    LEFT JOIN t ON NOT o.told AND t.state = w.now AND t.signal = o.signal)
SELECT user_id, event_id, CASE WHEN until IS NOT NULL THEN 'HUNG' ELSE now END AS state, fault::INT AS fault, sessions::BIGINT AS sessions, faults::BIGINT AS faults, answer FROM m WHERE event_id IS NOT NULL""")
def commanded_devices(spark, sf_dir):
    """Every eleventh event is a command from outside; a hung device is silent for six hours here."""
    rows = events(spark, sf_dir)
    told = F.col("event_id") % 11 == 0
    letter = F.element_at(F.array(*map(F.lit, ("i", "Z", "H", "x"))), (F.floor(F.col("event_id") / 11) % 4 + 1).cast("int"))
    commands = rows.filter(told).select("event_id", "user_id", "ts", letter.alias("command"))
    return integrity.commanded(_signals(rows.filter(~told)), commands, machine.advance, hang_us=6 * 3_600_000_000)


@query("""
WITH RECURSIVE o AS (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_type = 'purchase' AS begins, event_type = 'view' AS closed, value % 50 - 2 AS way,
    event_type <> 'error' AS reached, round(value * 40)::BIGINT - 2000 AS error, event_id % 3 <> 0 AS reached2, round(((value * 7) % 100) * 40)::BIGINT - 2000 AS error2 FROM events),
v AS (
  SELECT *, CASE WHEN NOT closed AND way <= 0.2 THEN 'stuck' WHEN NOT closed AND NOT reached THEN 'open' WHEN closed THEN 'resting' ELSE 'moved' END AS b1,
    CASE WHEN way * 0.7 <= 0.2 THEN 'stuck' WHEN NOT reached2 THEN 'open' ELSE 'moved' END AS b2 FROM o),
p AS (SELECT *, b1 IN ('resting', 'moved') AND abs(error) <= 960 AS ok1, b2 = 'moved' AND abs(error2) <= 960 AS ok2, b1 IN ('resting', 'moved') AND abs(error) > 960 AS drift FROM v),
m AS (
  SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::VARCHAR AS branch, NULL::BOOLEAN AS passed, NULL::BIGINT AS steps, 0::BIGINT AS corrected, 0 AS retries, 0 AS fault FROM o WHERE k = 1
  UNION ALL
  SELECT p.user_id, p.k, p.event_id, CASE WHEN ok1 OR r >= 1 THEN b1 ELSE 'again_' || b2 END, CASE WHEN ok1 OR r >= 1 THEN ok1 ELSE ok2 END,
    CASE WHEN ok1 OR r >= 1 THEN CASE WHEN b1 IN ('resting', 'moved') THEN trunc(error / 32.0)::BIGINT END WHEN b2 = 'moved' THEN trunc(error2 / 32.0)::BIGINT END,
    c + CASE WHEN ok1 AND b1 = 'moved' THEN error WHEN NOT ok1 AND r < 1 AND ok2 THEN error2 ELSE 0 END,
    CASE WHEN ok1 THEN 0 WHEN r >= 1 THEN r ELSE r + 1 END,
    CASE WHEN ok1 THEN f WHEN r >= 1 OR NOT ok2 THEN 6 WHEN drift OR f = 7 THEN 0 ELSE f END
  FROM m JOIN p ON p.user_id = m.user_id AND p.k = m.k + 1,
    LATERAL (SELECT CASE WHEN begins THEN 0 ELSE m.corrected END AS c, CASE WHEN begins THEN 0 ELSE m.retries END AS r, CASE WHEN begins THEN 0 ELSE m.fault END AS f) s)
SELECT user_id, event_id, branch, passed, steps::INT AS error_steps, corrected, retries::INT AS retries, fault::INT AS fault FROM m WHERE event_id IS NOT NULL""")
def integrity_retries(spark, sf_dir):
    """Every event is a visit: three branches, errors taken and corrected, one retry, a drift that it clears."""
    v = F.col("value")
    steps = lambda x: F.round(x * 40).cast("long") - 2000
    rows = events(spark, sf_dir).select(
        "user_id", "event_id", "ts", (F.col("event_type") == "purchase").alias("begins"), (F.col("event_type") == "view").alias("closed"), (v % 50 - 2).alias("way"),
        (F.col("event_type") != "error").alias("reached"), steps(v).alias("error"), (F.col("event_id") % 3 != 0).alias("reached_again"), steps((v * 7) % 100).alias("error_again"),
    )
    return integrity.visits(rows)


@query("""
WITH l AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN CASE WHEN value < 95 THEN 32 ELSE 16 END END IGNORE NULLS) OVER
  (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS register FROM events)
SELECT event_id, user_id, register::INT AS register FROM l WHERE event_type = 'purchase' AND coalesce(register <> 32, true)""")
def microstep_sanity(spark, sf_dir):
    """Strokes before which the register wasn't read as 32."""
    e = events(spark, sf_dir)
    register = F.when(F.col("event_type") == "view", F.when(F.col("value") < 95, 32).otherwise(16))
    return integrity.unverified(e, F.col("event_type") == "purchase", register, 32, "user_id", ORDER).select("event_id", "user_id", "register")


@query("""
WITH m AS (SELECT event_id, user_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) // 1000000 AS ms, value, 1 + value % 30 AS speed FROM events)
SELECT event_id, user_id, ms::BIGINT AS ms, floor(value / greatest(speed, 1) * 3000)::BIGINT + 4000 AS limit_ms FROM m WHERE ms > floor(value / greatest(speed, 1) * 3000)::BIGINT + 4000""")
def move_timeouts(spark, sf_dir):
    """Moves that took longer than three times what they should, and 4 s; a second between readings stands for a millisecond."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    ms = F.floor((F.unix_micros(F.lead("ts").over(w)) - F.unix_micros("ts")) / 1_000_000).cast("long")
    rows = events(spark, sf_dir).select("event_id", "user_id", ms.alias("ms"), profile.move_limit_ms(F.col("value"), F.col("value") % 30 + 1).alias("limit_ms"))
    return rows.filter("ms > limit_ms")
