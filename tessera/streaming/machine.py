"""The device's state machine, driven by signals: as a batch fold over each device, and as a streaming processor."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.blocked import blocked_fold, transition_functions
from tessera.operators.gated import ordered_fold
from tessera.sources import golden

_NEXT = {(s, signal): (to, fault) for s, signal, to, fault in golden.TRANSITIONS}
OUT = "user_id long, event_id long, ts timestamp, from_state string, to_state string, fault int"


def _fold(state: tuple | None, event_id: int, ts: int, signal: str | None) -> tuple:
    now, fault = state or ("BOOT", 0)
    to, fault = advance(now, fault, signal)
    return (to, fault), (event_id, ts, now, to, fault)


def advance(now: str, fault: int, signal: str) -> tuple[str, int]:
    """The next state and fault: the first fault stays until the next start."""
    to, code = _NEXT.get((now, signal), (now, 0))
    return to, 0 if to == "PREWARM" and now != to else fault or code


def transitions(signals: DataFrame) -> DataFrame:
    """Signals (event_id, user_id, ts, signal) to the transitions they cause."""
    out = OUT.removeprefix("user_id long, ").replace("ts timestamp", "ts long")
    rows = ordered_fold(signals, _fold, "user_id", ["ts", "event_id"], ["event_id", "ts", "signal"], out)
    return rows.filter("from_state != to_state").withColumn("ts", F.timestamp_micros("ts"))


def _next(now: str, signal: str | None) -> tuple[str, int]:
    return _NEXT.get((now, signal), (now, 0))


def hot_transitions(signals: DataFrame, parts: int | None = None) -> DataFrame:
    """T1, T18 as transitions() gives them, where a device may have any share of the signals."""
    states = sorted({s for s, *_ in golden.TRANSITIONS} | {to for _, _, to, _ in golden.TRANSITIONS})
    maps = transition_functions(states, "BOOT", _next, "PREWARM")
    out = OUT.removeprefix("user_id long, ").replace("ts timestamp", "ts long")
    rows = blocked_fold(signals, _fold, maps, "user_id", ["ts", "event_id"], ["event_id", "ts", "signal"], out, parts)
    return rows.filter("from_state != to_state").withColumn("ts", F.timestamp_micros("ts"))


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now, fault = state.get if state.exists else ("BOOT", 0)
    rows, out = pd.concat(list(batches)).sort_values(["ts", "event_id"]), []
    for event_id, ts, signal in zip(rows["event_id"], rows["ts"], rows["signal"], strict=True):
        to, fault = advance(now, fault, signal)
        if to != now:
            out.append((key[0], event_id, ts, now, to, fault))
        now = to
    state.update((now, fault))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def stream_transitions(signals: DataFrame) -> DataFrame:
    """T1, T2 over a stream of signals; a device's state is kept between batches, whose rows are taken in order of ts."""
    return signals.groupBy("user_id").applyInPandasWithState(_step, OUT, "state string, fault int", "append", GroupStateTimeout.NoTimeout)
