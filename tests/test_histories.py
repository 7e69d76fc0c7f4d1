"""Folds of hot devices, equal sequences, exact quantiles, logs and trees."""

import math
import random
import statistics

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import blocked, gated, logs, quantiles, sequences, trees
from tessera.plans.registry import ORDER, events
from tessera.plans.session_queries import _signals
from tessera.streaming import machine

CONTROL = {"target": 60.0, "hysteresis": 0.5, "limit": 90.0, "kp": 8.0, "ki": 0.25, "period_s": 0.5, "most_integral": 40.0, "most_duty": 80.0}


def keyed(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocked, "BLOCK", 7)


@pytest.mark.parametrize("hot", [True, False])
def test_hot_controller_equals_the_fold(spark, sf, hot, small_blocks):
    rows = events(spark, sf).select("event_id", "user_id", "ts", F.when(F.col("event_id") % 13 != 0, F.col("value")).alias("value"))
    rows = rows.withColumn("user_id", F.lit(None).cast("long") if hot else F.col("user_id"))
    a, b = (df.toPandas().sort_values("event_id") for df in (gated.hot_pi_control(rows, **CONTROL, parts=9), gated.pi_control(rows, **CONTROL)))
    assert len(a) == len(b) and np.allclose(a["integral"], b["integral"], atol=1e-9) and (a["duty"].values == b["duty"].values).all()


@pytest.mark.parametrize("hot", [True, False])
def test_hot_machine_equals_the_fold(spark, sf, hot, small_blocks):
    rows = _signals(events(spark, sf))
    rows = rows.withColumn("user_id", F.lit(1).cast("long")) if hot else rows
    columns = ["event_id", "user_id", "from_state", "to_state", "fault"]
    want = keyed(machine.transitions(rows), *columns)
    assert want and keyed(machine.hot_transitions(rows, parts=9), *columns) == want


def test_hot_machine_on_every_signal_and_null(spark, small_blocks):
    rng = random.Random(2)
    names = [None, *sorted({s for _, s, *_ in machine.golden.TRANSITIONS})]
    rows = [(k, 5 if k % 50 else None, k // 3, rng.choice(names)) for k in range(4000)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, us long, signal string").withColumn("ts", F.timestamp_micros("us"))
    columns = ["event_id", "user_id", "from_state", "to_state", "fault"]
    assert keyed(machine.hot_transitions(df, parts=16), *columns) == keyed(machine.transitions(df), *columns)
    assert machine.hot_transitions(df.limit(0)).count() == 0


def test_a_hot_key_is_spread_over_tasks(spark, sf, monkeypatch):
    """No task has more than twice the median of the rows."""
    seen = {}
    monkeypatch.setattr(blocked, "written", lambda df, name: seen.setdefault(name, spark.createDataFrame(df.toPandas(), df.schema)))
    rows = events(spark, sf).withColumn("user_id", F.lit(1).cast("long"))
    gated.hot_pi_control(rows, **CONTROL, parts=8).count()
    sizes = [r[1] for r in seen["blocks"].filter("rows IS NOT NULL").groupBy("task").agg(F.sum(F.size("rows"))).collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * statistics.median(sizes)


def test_maps_compose_as_their_rows_do():
    rng = random.Random(1)
    maps = blocked.clamped_shifts(lambda *v: v)
    for _ in range(300):
        f, g, h = ((rng.uniform(-5, 5), *sorted((rng.uniform(-9, 9), rng.uniform(-9, 9)))) for _ in range(3))
        x = (rng.uniform(-20, 20),)
        one = maps.apply(h, maps.apply(g, maps.apply(f, x)))[0]
        assert math.isclose(one, maps.apply(maps.then(maps.then(f, g), h), x)[0], abs_tol=1e-9)
        assert math.isclose(one, maps.apply(maps.then(f, maps.then(g, h)), x)[0], abs_tol=1e-9)


def plain_prefixes(seqs):
    out = []
    for key, s in seqs.items():
        same = min(k for k, t in seqs.items() if t == s)
        best = max((n for n in range(1, len(s) + 1) if any(k != key and t[:n] == s[:n] and len(t) >= n for k, t in seqs.items())), default=0)
        first = min((k for k, t in seqs.items() if len(t) >= best and t[:best] == s[:best]), default=None) if best else None
        out.append((key, len(s), same, best, first))
    return sorted(out)


def test_shared_prefixes_equal_the_plain_ones(spark, small_blocks):
    rng = random.Random(4)
    base = [rng.choice(["a", "b", None]) for _ in range(60)]
    seqs = {k: base[: rng.randint(1, 60)] + [rng.choice("abc") for _ in range(rng.randint(0, 3))] for k in range(25)}
    seqs |= {30: base, 31: base, 32: ["z"], 33: [None], 34: [None], 35: ["-"]}
    rows = [(k, n, x) for k, s in seqs.items() for n, x in enumerate(s)] + [(None, 0, "a")]
    df = spark.createDataFrame(rows, "key long, n long, item string").repartition(5)
    got = sequences.shared_prefixes(df, "key", ["n"], "item")
    assert sorted(map(tuple, got.collect())) == plain_prefixes(seqs)
    assert sequences.shared_prefixes(df.limit(0), "key", ["n"], "item").count() == 0


def test_prefixes_with_equal_fingerprints_are_held_against_the_values(spark, monkeypatch):
    """Whatever the fingerprint says, no longer prefix is claimed than there is."""
    import tessera.operators.sequences as module

    monkeypatch.setattr(module, "PRIME", 3)
    seqs = {1: list("abcd"), 2: list("abxy"), 3: list("q")}
    df = spark.createDataFrame([(k, n, x) for k, s in seqs.items() for n, x in enumerate(s)], "key long, n long, item string")
    for key, _, _, common, _ in map(tuple, module.shared_prefixes(df, "key", ["n"], "item").collect()):
        assert common <= {1: 2, 2: 2, 3: 0}[key]


def test_quantiles_equal_numpy_with_odd_values(spark):
    rng = random.Random(7)
    odd = [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, float("inf"), float("-inf"), 1.0, 1.0, 1.0, np.nextafter(1.0, 2)]
    groups = {"a": odd, "b": [rng.gauss(0, 1e-3) for _ in range(999)], None: [3.0], "c": [rng.choice([1.5, 2.5]) for _ in range(100)]}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("d", None), ("b", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(r["g"], r["share"]): r["quantile"] for r in quantiles.exact_quantiles(df, "x", shares, ["g"]).collect()}
    assert len(got) == 4 * len(shares)
    for g, xs in groups.items():
        s = sorted(xs)
        for share in shares:
            at = share * (len(s) - 1)
            low, high = s[math.floor(at)], s[math.ceil(at)]
            want = low if math.floor(at) == math.ceil(at) else low + (high - low) * (at - math.floor(at))
            assert got[g, share] == want or math.isnan(want) and math.isnan(got[g, share])
    whole = quantiles.exact_quantiles(df.filter("g = 'b'"), "x", [0.5]).collect()
    assert [tuple(r) for r in whole] == [(0.5, statistics.median(groups["b"]))]
    assert quantiles.exact_quantiles(df.limit(0), "x", [0.5]).count() == 0


def test_log_checks_of_odd_logs(spark):
    rows = [(1, 0, 5.0), (1, 60, 5.5), (1, 100_000, 20.0), (2, 0, None), (3, 0, -4.0), (None, 0, 1.0), (None, 5, 99.0)]
    df = spark.createDataFrame(rows, "k long, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["k"]: r for r in logs.check_log(df, "k", "ts", ["ts"], "v", 6.0, 0.0, 100.0, 10, 2.0, 86_400.0).collect()}
    assert (got[1]["n"], got[1]["near"], got[1]["parked"], got[1]["gap_median"], got[1]["gap_max"]) == (3, 1, 1, (60 + 99_940) / 2, 99_940)
    assert got[2]["fullest"] is None and got[2]["gap_median"] is None and got[3]["low_spike"] is None
    assert (got[None]["low_spike"], got[None]["high_spike"], got[None]["fullest"]) == (25.0, 25.0, 5.0)


def test_a_chain_of_ten_thousand_in_few_rounds(spark):
    n = 10_000
    df = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("up"), F.lit(1).cast("long").alias("v"))
    got = trees.subtree_sums(df, "node", "up", ["v"]).toPandas().sort_values("node")
    assert (got["depth"].values == np.arange(n)).all() and (got["v"].values == n - np.arange(n)).all() and (got["root"] == 0).all()
    assert got["rounds"].iloc[0] < 20


def test_trees_with_odd_parents_and_circles(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", "a", None), ("c", "a", 5), ("d", "gone", 7), ("e", "c", 2)], "n string, p string, v long")
    got = {r["n"]: (r["depth"], r["root"], r["v"]) for r in trees.subtree_sums(df, "n", "p", ["v"]).collect()}
    assert got == {"a": (0, "a", 8), "b": (1, "a", 0), "c": (1, "a", 7), "d": (0, "d", 7), "e": (2, "a", 2)}
    with pytest.raises(ValueError, match="circle"):
        trees.subtree_sums(spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "n string, p string, v long"), "n", "p", ["v"], most_rounds=4)
    assert trees.subtree_sums(df.limit(0), "n", "p", ["v"]).count() == 0


def test_quantiles_equal_duckdb_on_events(spark, sf):
    got = quantiles.exact_quantiles(events(spark, sf), "value", [0.25, 0.5]).toPandas().sort_values("share")["quantile"].tolist()
    want = duckdb.sql(f"SELECT quantile_cont(value, [0.25, 0.5]) FROM '{sf}/events.parquet'").fetchall()[0][0]
    assert np.allclose(got, want, rtol=0, atol=1e-12)


def test_order_is_kept_for_ties(spark):
    pdf = pd.DataFrame({"event_id": [3, 1, 2], "user_id": [1, 1, 1], "value": [10.0, 70.0, 95.0]})
    df = spark.createDataFrame(pdf).withColumn("ts", F.timestamp_seconds(F.lit(0)))
    a, b = (keyed(x, "event_id", "integral", "duty") for x in (gated.hot_pi_control(df, **CONTROL, parts=3), gated.pi_control(df, **CONTROL)))
    assert a == b and ORDER == ["ts", "event_id"]


def test_hot_runs_equal_counting(spark, small_blocks):
    rng = random.Random(11)
    hits = [rng.choice([True, True, True, False, None]) for _ in range(600)]
    df = spark.createDataFrame([(k, None, k // 2, h) for k, h in enumerate(hits)], "event_id long, user_id long, s long, hit boolean").withColumn("ts", F.timestamp_seconds("s"))
    want, run = [], 0
    for k, h in enumerate(hits):
        run = run + 1 if h else 0
        want.append((k, run))
    got = blocked.hot_runs(df.drop("hit").join(df.select("event_id", "hit"), "event_id"), F.col("hit"), "user_id", ORDER, parts=7)
    assert sorted((r["event_id"], r["run"]) for r in got.collect()) == want
