"""Streaming forms of the sequence operators: a key's state is small and fixed."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.gated import gate

HITS = "user_id long, event_id long, value double, run long"
GATED = "user_id long, event_id long, kept double, bad int, credible boolean"


def _run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, over: float, n: int) -> Iterator[pd.DataFrame]:
    run, out = state.get[0] if state.exists else 0, []
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    for event_id, value in zip(rows["event_id"], rows["value"], strict=True):
        run = run + 1 if value > over else 0
        if run >= n:
            out.append((key[0], event_id, value, run))
    state.update((run,))
    yield pd.DataFrame(out, columns=["user_id", "event_id", "value", "run"])


def stream_consecutive(readings: DataFrame, over: float, n: int) -> DataFrame:
    """Readings that are at least the n-th in a row over a threshold."""
    return readings.groupBy("user_id").applyInPandasWithState(partial(_run, over=over, n=n), HITS, "run long", "append", GroupStateTimeout.NoTimeout)


def _gate(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, **limits: float) -> Iterator[pd.DataFrame]:
    now, out = state.get if state.exists else None, []
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    for event_id, ts, value in zip(rows["event_id"], rows["ts"], rows["value"], strict=True):
        now, found = gate(now, ts.value // 1000, None if pd.isna(value) else value, **limits)
        out.append((key[0], event_id, *found))
    state.update(now)
    yield pd.DataFrame(out, columns=["user_id", "event_id", "kept", "bad", "credible"])


def stream_credibility(readings: DataFrame, low: float, high: float, most_rate: float, most_bad: int) -> DataFrame:
    """P1 over a stream."""
    step = partial(_gate, low=low, high=high, most_rate=most_rate, most_bad=most_bad)
    return readings.groupBy("user_id").applyInPandasWithState(step, GATED, "seen long, kept double, bad int", "append", GroupStateTimeout.NoTimeout)


def stream_blocks(readings: DataFrame, late: str = "10 minutes", block: str = "225 seconds") -> DataFrame:
    """T4, A2: least and largest reading of each tumbling block, once it can't change any more."""
    rows = readings.withWatermark("ts", late).groupBy("user_id", F.window("ts", block))
    return rows.agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))


def _silence(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, ms: int) -> Iterator[pd.DataFrame]:
    out = []
    if state.hasTimedOut:
        out = [(key[0], state.get[0])]
        state.remove()
    else:
        last = max([b["ts"].max().value // 1_000_000 for b in batches] + ([state.get[0]] if state.exists else []))
        state.update((last,))
        state.setTimeoutTimestamp(max(last + ms, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(out, columns=["user_id", "silent_since_ms"])


def stream_silences(readings: DataFrame, ms: int, late: str = "1 second") -> DataFrame:
    """Devices that event time has left behind by more than ms: a timer on the watermark."""
    rows = readings.withWatermark("ts", late).groupBy("user_id")
    return rows.applyInPandasWithState(partial(_silence, ms=ms), "user_id long, silent_since_ms long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
