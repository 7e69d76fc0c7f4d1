"""Acceptance reports, budgets and scores as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import sensor
from tessera.operators import acceptance, sequence, session
from tessera.plans.registry import query, table
from tessera.sources import golden


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)


@query("""
WITH r(s, p, d, printed, s2, p2, d2, printed2) AS (VALUES %s)
SELECT CASE WHEN s * p * d >= 60 OR s = 5 THEN 'act' WHEN s * p * d >= 40 THEN 'reduce' WHEN s * p * d >= 20 THEN 'watch' WHEN s * p * d >= 10 THEN 'note' ELSE 'accept' END AS band,
  count(*) AS n, count(*) FILTER (s * p * d <> printed) AS misprints, sum(s2 * p2 * d2)::BIGINT AS after FROM r GROUP BY 1""" % _values(golden.RISKS))
def risk_bands(spark, sf_dir):
    """D-23: risks by band, and where the printed product is wrong."""
    n, band = sensor.risk(F.col("s"), F.col("p"), F.col("d"))
    after, _ = sensor.risk(F.col("s2"), F.col("p2"), F.col("d2"))
    return golden.risks(spark).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.count_if(n != F.col("printed")).alias("misprints"), F.sum(after).alias("after"))


@query("""
WITH p(block, quantity, cents) AS (VALUES %s)
SELECT coalesce(block, 'total') AS block, sum(quantity * cents)::BIGINT AS cents, count(*) AS lines FROM p GROUP BY ROLLUP (block)""" % _values([(b, q, c) for b, own in golden.PARTS.items() for q, c in own]))
def cost_rollup(spark, sf_dir):
    """D-24: block subtotals and the total."""
    return golden.parts(spark).rollup("block").agg(F.sum(F.col("quantity") * F.col("unit_cents")).alias("cents"), F.count("*").alias("lines")).withColumn("block", F.coalesce("block", F.lit("total")))


@query("""
WITH t(celsius, adc) AS (VALUES %s)
SELECT celsius, adc, abs(1 / (1 / 298.15 + ln(10000.0 * adc / (4095 - adc) / 10000.0) / 3950.0) - 273.15 - celsius) <= 0.5 AS ok FROM t""" % _values(golden.THERMISTOR))
def thermistor_golden(spark, sf_dir):
    """F1 against the published table."""
    return golden.thermistor(spark).withColumn("ok", F.abs(sensor.beta_temperature(F.col("adc")) - F.col("celsius")) <= 0.5)


@query("WITH t(mm, mn) AS (VALUES %s) SELECT mm, mn, round(0.040875 * (4785 + 40 * mm)) = mn AS ok FROM t" % _values(golden.WEIGHT_SCALE))
def weight_golden(spark, sf_dir):
    """D-22 against the published table."""
    return golden.weight_scale(spark).withColumn("ok", F.round(sensor.weight_force(F.col("mm"))) == F.col("mn"))


@query("""
WITH s AS (SELECT (4096 + k * 2654435761) % 4294967296 AS seed FROM range(200) r(k)), b AS (SELECT unnest(range(32)) AS bit, seed FROM s)
SELECT bit::INT AS bit, round(avg((seed >> bit) & 1), 6) AS ones, (SELECT count(DISTINCT seed) FROM s) AS seeds FROM b GROUP BY bit""")
def seed_checks(spark, sf_dir):
    """D-14: distinct seeds and the share of ones in each bit."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: F.floor(F.col("seed") / F.pow(F.lit(2.0), b)).cast("long") % 2)
    each = golden.seeds(spark).select("seed", F.posexplode(bits).alias("bit", "one"))
    return each.groupBy("bit").agg(F.round(F.avg("one"), 6).alias("ones"), F.countDistinct("seed").alias("seeds"))


@query("""
WITH p(preset, weight, means, sigma, tau, log_mode, gap_low, gap_high, flight, graze, jump_low, jump_high) AS (VALUES %s),
f AS (SELECT preset, list_sum(means::DOUBLE[]) / len(means) AS mean, sigma::DOUBLE AS sigma, (gap_low + gap_high)::DOUBLE AS gaps, flight::DOUBLE AS flight, 0.040875::DOUBLE * (4785 + 40 * weight) AS force FROM p)
SELECT f.preset, round(f.mean / b.mean, 6) AS mean, round(f.sigma / b.sigma, 6) AS sigma, round(f.gaps / b.gaps, 6) AS gaps, round(f.flight / b.flight, 6) AS flight, round(f.force / b.force, 6) AS force
FROM f, f b WHERE b.preset = 'base'""" % _values(golden.PRESETS))
def preset_ratios(spark, sf_dir):
    """D-15: each preset's figures relative to the first."""
    rows = golden.presets(spark)
    mean = F.aggregate("means", F.lit(0.0), lambda a, x: a + x) / F.size("means")
    rows = rows.select("preset", mean.alias("mean"), "sigma", (F.col("gap_low") + F.col("gap_high")).alias("gaps"), "flight", sensor.weight_force(F.col("weight_mm")).alias("force"))
    base = lambda c: F.max(F.when(F.col("preset") == "base", F.col(c))).over(Window.partitionBy())  # noqa: E731  four rows
    return rows.select("preset", *[F.round(F.col(c) / base(c), 6).alias(c) for c in ("mean", "sigma", "gaps", "flight", "force")])


@query()
def log_acceptance(spark, sf_dir):
    """D-11, D-12: the acceptance checks over a simulated log."""
    s = session.simulate(golden.seeds(spark))
    w = Window.partitionBy("session_id").orderBy("n")
    moves = s.filter("target IS NOT NULL").withColumns({"m1": F.lag("target", 1).over(w), "m2": F.lag("target", 2).over(w)})
    apart = lambda c: F.coalesce(F.abs(F.col("target") - F.col(c)) >= 6 - 1e-9, F.lit(True))
    own = session.report(s)
    period = s.withColumn("period", F.lead("t_s").over(w) - F.col("t_s")).groupBy("session_id").agg(F.stddev("period").alias("period_sd"))
    far = moves.groupBy("session_id").agg(F.bool_and(apart("m1") & apart("m2")).alias("separated"))
    rows = own.join(period, "session_id").join(far, "session_id", "left")
    c = F.col
    return acceptance.checks(
        rows,
        ("strokes_least", acceptance.rule(F.min("strokes"), lambda v: v >= 45)), ("strokes_most", acceptance.rule(F.max("strokes"), lambda v: v <= 85)),
        ("ends_in_time", acceptance.rule(F.max("t_final"), lambda v: v <= 860.0 + 1e-6)), ("gap_least", acceptance.rule(F.min("gap_low"), lambda v: v >= 1.5)),
        ("gap_most", acceptance.rule(F.max("gap_high"), lambda v: v <= 5.5)), ("dwell_most", acceptance.rule(F.max("dwell_high"), lambda v: v <= 10.0)),
        ("v_least", acceptance.rule(F.min("v_low"), lambda v: v >= 20.0)), ("v_most", acceptance.rule(F.max("v_high"), lambda v: v <= 70.0)),
        ("two_back", acceptance.rule(F.avg(F.coalesce(c("separated"), F.lit(True)).cast("int")), lambda v: v == 1.0)), ("period_sd", acceptance.rule(F.min("period_sd"), lambda v: v >= 1.0)),
    )


@query()
def radius_coverage(spark, sf_dir):
    """D-11: where the simulated strokes lie, in ten bands."""
    return sequence.coverage(session.simulate(golden.seeds(spark)), "radius", 276.0, 324.0, 10)


@query("""
WITH p AS (SELECT l_partkey, l_linenumber, max(l_quantity) AS worst, (max(l_quantity) - min(l_quantity)) / avg(l_quantity) AS spread FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, round(max(worst) * 1.4, 6) AS design, bool_or(spread > 0.4) AS red FROM p GROUP BY 1""")
def worst_of_readings(spark, sf_dir):
    """D-38 over quantities by part and line number."""
    out = acceptance.worst_of(table(spark, sf_dir, "lineitem"), "l_quantity", "l_linenumber", "l_partkey", 1.4, 0.4)
    return out.withColumn("design", F.round("design", 6))


@query("""
SELECT n_regionkey, round(sum(c_acctbal * c_nationkey) / sum(c_acctbal), 4) AS centre, round(sum(c_acctbal), 2) AS mass FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def centre_of_gravity(spark, sf_dir):
    """D-28 over balances by region."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return acceptance.centre(rows, "c_acctbal", "c_nationkey", "n_regionkey").select("n_regionkey", F.round("centre", 4).alias("centre"), F.round("mass", 2).alias("mass"))


@query("""
SELECT p_partkey, round(p_size * 0.5 + p_retailprice * 0.01, 6) AS score, rank() OVER (ORDER BY round(p_size * 0.5 + p_retailprice * 0.01, 6) DESC) AS rank FROM part""")
def weighted_scores(spark, sf_dir):
    """D-29."""
    rows = table(spark, sf_dir, "part")
    score = F.round(F.col("p_size") * 0.5 + F.col("p_retailprice") * 0.01, 6)
    return acceptance.weighted_rank(rows.withColumn("s", score), {"s": 1.0}, "p_partkey").withColumn("rank", F.col("rank").cast("long"))


@query("""
SELECT o_orderkey, o_custkey, sum(round(o_totalprice * 100)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM orders""")
def scenario_totals(spark, sf_dir):
    """D-35: running totals."""
    rows = table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    return acceptance.running_total(rows, "cents", "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey", "running")


@query("""
WITH a AS (SELECT c_nationkey AS k, count(*) AS v FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS v FROM supplier GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, a.v AS "left", b.v AS "right", coalesce(a.v, 0) - coalesce(b.v, 0) AS difference FROM a FULL JOIN b ON a.k = b.k""")
def reconciled(spark, sf_dir):
    """D-36: two counts of the same nations."""
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("v"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("v"))
    return acceptance.reconcile(a, b, "k", "v")


@query("""
WITH e AS (SELECT DISTINCT c_nationkey AS k, c_mktsegment AS f FROM customer)
SELECT a.k AS a, b.k AS b, count(*) AS shared FROM e a JOIN e b USING (f) WHERE a.k < b.k GROUP BY 1, 2""")
def layer_pairs(spark, sf_dir):
    """D-39: what pairs of nations share."""
    return acceptance.pairs_apart(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment")


@query("SELECT o_custkey, count(*) AS n, bool_and(o_totalprice < 400000) AND count(*) >= 10 AS accepted FROM orders GROUP BY 1")
def ten_of_ten(spark, sf_dir):
    """D-41, D-42: series of ten or more that all stay under a limit."""
    return acceptance.all_pass(table(spark, sf_dir, "orders"), F.col("o_totalprice") < 400_000, "o_custkey", 10)


@query("""
SELECT r_name, n_name, count(c_custkey) AS leaves, count(c_custkey) FILTER (c_acctbal < 0) AS failed FROM region JOIN nation ON n_regionkey = r_regionkey
LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ROLLUP (r_name, n_name)""")
def failure_tree(spark, sf_dir):
    """D-40: leaf states counted up a tree."""
    rows = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.join(table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.rollup("r_name", "n_name").agg(F.count("c_custkey").alias("leaves"), F.count_if(F.col("c_acctbal") < 0).alias("failed"))


@query("""
SELECT l_returnflag, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS mean_load, max(l_quantity) AS peak FROM lineitem GROUP BY 1""")
def power_budget(spark, sf_dir):
    """D-25: a duty-weighted mean and the peak."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_quantity") * F.col("l_discount")) / F.sum("l_quantity"), 6).alias("mean_load"), F.max("l_quantity").alias("peak"))


@query("""
WITH f(code, meaning) AS (VALUES %s)
SELECT code, meaning, count(event_id) AS n FROM f LEFT JOIN events ON event_id %% 17 = code AND event_type = 'error' GROUP BY 1, 2""" % _values(list(golden.FAULTS.items())))
def fault_labels(spark, sf_dir):
    """D-31: codes to labels by a join with the small table."""
    e = table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", (F.col("event_id") % 17).alias("c"))
    return golden.faults(spark).join(e, F.col("c") == F.col("code"), "left").groupBy("code", "meaning").agg(F.count("event_id").alias("n"))
