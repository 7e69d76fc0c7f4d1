"""Histories of any length: folds of one hot device, equal sequences, acceptance of a log, trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import blocked, gated, logs, quantiles, sequences, trees
from tessera.plans.registry import ORDER, QUERIES, events, query, table
from tessera.plans.session_queries import _signals
from tessera.streaming import machine

ONE_DEVICE = "(SELECT * REPLACE (0::BIGINT AS user_id) FROM events)"


@query(QUERIES["pi_integrator"][1].replace("FROM events", f"FROM {ONE_DEVICE} events"))
def hot_pi_integrator(spark, sf_dir):
    """W6 with all readings those of one device: clamped shifts composed over blocks, then replayed."""
    rows = events(spark, sf_dir).select("event_id", F.lit(0).cast("long").alias("user_id"), "ts", "value")
    out = gated.hot_pi_control(rows, target=60.0, hysteresis=0.5, limit=90.0, kp=8.0, ki=0.25, period_s=0.5, most_integral=40.0, most_duty=80.0)
    return out.select("event_id", F.round("integral", 6).alias("integral"), "duty")


@query(QUERIES["state_machine"][1].replace("FROM events", f"FROM {ONE_DEVICE} events"))
def hot_state_machine(spark, sf_dir):
    """T1, T18 with all signals those of one device: transition functions composed over blocks, then replayed."""
    rows = _signals(events(spark, sf_dir)).withColumn("user_id", F.lit(0).cast("long"))
    return machine.hot_transitions(rows).select("event_id", "user_id", "from_state", "to_state", "fault")


@query(f"""
WITH h AS (SELECT event_id, value > 60 AS hit, row_number() OVER (ORDER BY ts, event_id) AS k FROM {ONE_DEVICE}),
b AS (SELECT *, max(CASE WHEN NOT hit THEN k ELSE 0 END) OVER (ORDER BY k) AS reset FROM h)
SELECT event_id, k - reset AS run FROM b WHERE k - reset >= 3""")
def hot_consecutive(spark, sf_dir):
    """W2, P3 with all readings those of one device: runs of three or more over the threshold."""
    rows = events(spark, sf_dir).withColumn("user_id", F.lit(0).cast("long"))
    return blocked.hot_runs(rows, F.col("value") > 60, "user_id", ORDER).filter("run >= 3").select("event_id", "run")


@query("""
WITH o AS (SELECT user_id, event_type, row_number() OVER w AS n, string_agg(event_type, ',') OVER w AS prefix FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
e AS (SELECT user_id, max(n) AS length, arg_max(prefix, n) AS whole FROM o GROUP BY 1),
g AS (SELECT prefix, n, count(*) AS keys, min(user_id) AS first FROM o GROUP BY 1, 2 HAVING count(*) > 1),
l AS (SELECT user_id, max(o.n) AS n, arg_max(first, o.n) AS first FROM o JOIN g ON o.n = g.n AND o.prefix = g.prefix GROUP BY 1)
SELECT user_id, length, min(user_id) OVER (PARTITION BY whole) AS same_as, coalesce(l.n, 0) AS common_prefix, l.first AS first_with_it FROM e LEFT JOIN l USING (user_id)""")
def equal_sequences(spark, sf_dir):
    """D-14: devices whose sequences of events are equal, and the longest beginning that each shares with another."""
    return sequences.shared_prefixes(events(spark, sf_dir), "user_id", ORDER, "event_type")


@query("""
SELECT event_type, 0.1::DOUBLE AS share, round(quantile_cont(value, 0.1), 9) AS quantile FROM events GROUP BY 1 UNION ALL
SELECT event_type, 0.5::DOUBLE, round(quantile_cont(value, 0.5), 9) FROM events GROUP BY 1 UNION ALL
SELECT event_type, 0.9::DOUBLE, round(quantile_cont(value, 0.9), 9) FROM events GROUP BY 1""")
def value_quantiles(spark, sf_dir):
    """D-12: exact median and tenths, by histograms of the bits of a double."""
    found = quantiles.exact_quantiles(events(spark, sf_dir), "value", [0.1, 0.5, 0.9], ["event_type"])
    return found.select("event_type", "share", F.round("quantile", 9).alias("quantile"))


@query("""
WITH o AS (SELECT user_id, epoch_us(ts) AS us, value AS v, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS gap,
  coalesce(abs(value - lag(value, 1) OVER w) < 6, false) OR coalesce(abs(value - lag(value, 2) OVER w) < 6, false) AS near,
  least(floor(value / 10), 9)::INT AS band FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, CASE WHEN v BETWEEN 0 AND 100 THEN band END AS b FROM o),
c AS (SELECT user_id, r.k AS b, count(i.b) AS n FROM (SELECT DISTINCT user_id FROM i) CROSS JOIN range(10) r(k) LEFT JOIN i USING (user_id) WHERE i.b IS NOT DISTINCT FROM r.k GROUP BY 1, 2),
h AS (SELECT user_id, max(n) AS most, CASE WHEN count(*) = 10 THEN min(n) ELSE 0 END AS fewest FROM c GROUP BY 1)
SELECT user_id, count(*) AS n, round((max(us) - min(us)) / 1e6, 6) AS duration_s, count(*) FILTER (near) AS near,
  round(any_value(most) * 10.0 / count(b), 6) AS fullest, round(any_value(fewest) * 10.0 / count(b), 6) AS emptiest, round(min(gap), 6) AS gap_min, round(median(gap), 3) AS gap_median,
  round(max(gap), 6) AS gap_max, round(stddev_pop(gap), 3) AS gap_sd, count(*) FILTER (gap >= 86400) AS parked,
  round(count(*) FILTER (b IS NOT NULL AND v <= 2) / count(b) / 0.02, 6) AS low_spike, round(count(*) FILTER (b IS NOT NULL AND v >= 98) / count(b) / 0.02, 6) AS high_spike
FROM i LEFT JOIN h USING (user_id) GROUP BY user_id""")
def log_checks(spark, sf_dir):
    """D-12: the log of each device held against its limits."""
    found = logs.check_log(events(spark, sf_dir), "user_id", "ts", ORDER, "value", 6.0, 0.0, 100.0, 10, 2.0, 86_400.0)
    return found.select("user_id", "n", "near", "parked", *[F.round(c, 3).alias(c) for c in ("gap_sd", "gap_median")], *[F.round(c, 6).alias(c) for c in ("duration_s", "fullest", "emptiest", "gap_min", "gap_max", "low_spike", "high_spike")])


@query("""
WITH RECURSIVE t AS (
  SELECT 'r' || r_regionkey AS node, NULL AS up, 0 AS leaf, 0 AS failed FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 0, 0 FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 0, 0 FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 1, (o_orderstatus = 'F')::INT FROM orders),
a AS (SELECT node, node AS above, 0 AS up, leaf, failed FROM t UNION ALL SELECT a.node, t.up, a.up + 1, a.leaf, a.failed FROM a JOIN t ON t.node = a.above WHERE t.up IS NOT NULL),
d AS (SELECT node, max(up) AS depth, arg_max(above, up) AS root FROM a GROUP BY 1)
SELECT above AS node, any_value(d.depth)::BIGINT AS depth, any_value(d.root) AS root, sum(leaf)::BIGINT AS leaves, sum(failed)::BIGINT AS failed FROM a JOIN d ON d.node = a.above GROUP BY 1""")
def tree_totals(spark, sf_dir):
    """D-40: orders counted up the tree of regions, nations and customers, whatever its depth."""
    part = lambda name, node, up, leaf, failed: table(spark, sf_dir, name).select(node.alias("node"), up.alias("up"), leaf.cast("long").alias("leaves"), failed.cast("long").alias("failed"))
    of = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    none = F.lit(0)
    nodes = part("region", of("r", "r_regionkey"), F.lit(None).cast("string"), none, none).unionByName(part("nation", of("n", "n_nationkey"), of("r", "n_regionkey"), none, none))
    nodes = nodes.unionByName(part("customer", of("c", "c_custkey"), of("n", "c_nationkey"), none, none)).unionByName(part("orders", of("o", "o_orderkey"), of("c", "o_custkey"), F.lit(1), F.col("o_orderstatus") == "F"))
    return trees.subtree_sums(nodes, "node", "up", ["leaves", "failed"]).select("node", "depth", "root", "leaves", "failed")
