"""Folds on a stream, in order of event time, with state that expires: the device's state machine, triggers and gates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.gated import gate
from tessera.streaming.machine import OUT, advance

#: Rows that are taken from or put into the state at a time.
ROWS = 4096
#: Groups that keys are dealt out to, each with one state: a call on the state costs much more than a row of it.
GROUPS = 512
WITHOUT_KEY = -1


class InOrder(StatefulProcessor):
    """A fold over each key's rows in order of event time: step(state, *values) -> (state, results or None).

    A group of keys has one state. Rows wait in a list until the watermark has passed them; then they are taken in order of
    (ts, event_id). Its timer stands at the first row that waits or where the first of its keys counts as idle, whichever is
    earlier; it is the only work of a batch that has no row of the group. The state of a key that is idle goes, and a later
    row begins with state None.
    """

    def __init__(self, step: Callable, state: str, key: str, columns: list[str], kinds: list[str], out: list[str], idle_ms: int, idle: Callable | None = None) -> None:
        self.step, self.columns, self.out, self.idle_ms, self.idle = step, columns, out, idle_ms, idle
        self.state = f"own_key {key}, last_us long, {state}"
        self.row = ", ".join([f"own_key {key}", "us long", "event_id long", *(f"v{k} {kind}" for k, kind in enumerate(kinds))])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getListState("known", self.state)
        self.timer = handle.getValueState("timer", "at long")
        self.waiting = handle.getListState("waiting", self.row)

    def _stand(self, at: int) -> None:
        """Sets the timer, to the earlier of two."""
        before = self.timer.get()[0] if self.timer.exists() else None
        if before is not None and before <= at:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    @staticmethod
    def _append(into, rows: list[tuple]) -> None:
        for a in range(0, len(rows), ROWS):
            into.appendList(rows[a : a + ROWS])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first, upto = None, timerValues.getCurrentWatermarkInMs()
        for part in rows:  # a part of the micro-batch at a time
            us = part["ts"].astype("datetime64[us]").astype("int64")
            # Spark lets rows through that only the newest watermark has passed; later ones may have been taken already
            part, us = part[us > upto * 1000], us[us > upto * 1000]
            if part.empty:
                continue
            first = int(us.min()) if first is None else min(first, int(us.min()))
            keys = [None] * len(part) if key[0] == WITHOUT_KEY else part["own_key"].tolist()
            values = [part[c].astype(object).where(part[c].notna(), None).tolist() for c in self.columns]
            self._append(self.waiting, list(zip(keys, us.tolist(), part["event_id"].tolist(), *values, strict=True)))
        if first is not None:
            self._stand(max(first // 1000 + 1, upto + 1))
        yield pd.DataFrame(columns=self.out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.timer.clear()
        upto = timerValues.getCurrentWatermarkInMs()
        ready, later = [], []
        for row in self.waiting.get():
            (ready if row[1] <= upto * 1000 else later).append(tuple(row))
        known = {k: (last, tuple(state)) for k, last, *state in self.known.get()}
        limit, out = self.idle_ms * 1000, []

        def fallen_idle(k, last: int, state: tuple) -> None:
            if self.idle is not None and (found := self.idle(state, last)) is not None:
                out.append((k, *found))

        for k, us, event_id, *values in sorted(ready, key=lambda r: r[1:3]):
            last, state = known.get(k, (None, None))
            if last is not None and us > last + limit:
                fallen_idle(k, last, state)
                state = None
            state, found = self.step(state, event_id, us, *values)
            known[k] = us, state
            if found is not None:
                out.append((k, *found))
            if len(out) >= ROWS:
                yield self._frame(out)
                out.clear()
        kept, next_idle = [], None
        for k, (last, state) in known.items():
            if last + limit < upto * 1000:
                fallen_idle(k, last, state)
            else:
                kept.append((k, last, *state))
                next_idle = last if next_idle is None else min(next_idle, last)
        self.known.clear()
        self._append(self.known, kept)
        if ready:
            self.waiting.clear()
            self._append(self.waiting, later)
        at = [min(row[1] for row in later) // 1000 + 1] if later else []
        at += [(next_idle + limit) // 1000 + 2] if kept else []
        if at:
            self._stand(max(min(at), upto + 1))
        yield self._frame(out)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        found = pd.DataFrame(rows, columns=self.out)
        return found.assign(ts=pd.to_datetime(found["ts"], unit="us")) if "ts" in self.out else found

    def close(self) -> None:
        pass


def fold_in_order(rows: DataFrame, step: Callable, state: str, key: str, columns: list[str], out: str, late: str, idle_ms: int, idle: Callable | None = None, groups: int = GROUPS) -> DataFrame:
    """A fold over a stream of rows (key, event_id, ts, columns), whatever files or batches they come in.

    step(state, event_id, microseconds, *columns) -> (state, values of the out columns or None); a state is a tuple of the
    schema `state`, None at a key's first row. Rows later than `late` behind the newest are dropped; a row counts when the
    watermark has passed it, so the last ones of a stream wait for newer ones of any key. A key that is silent for more
    than idle_ms begins anew, and its state goes; idle(state, last microsecond) may say so. Nulls are None, rows without ts are dropped, a null key is a key. State per
    key: one row, and the rows that wait; per group of keys: one timer. A task holds one group's rows in memory: `groups`
    should be a few for each shuffle partition, and more where a group's waiting rows are many. Needs RocksDB as the state store
    (spark.sql.streaming.stateStore.providerClass).
    """
    kinds = dict(rows.dtypes)
    placed = rows.select(key, "event_id", "ts", *columns).filter("ts IS NOT NULL").withWatermark("ts", late)
    # a null among whole numbers would make pandas hold them as floating-point ones
    own = F.coalesce(key, F.lit(0).cast(kinds[key])) if kinds[key] in ("tinyint", "smallint", "int", "bigint") else F.col(key)
    group = F.when(F.col(key).isNull(), WITHOUT_KEY).otherwise(F.pmod(F.xxhash64(key), F.lit(groups)))
    placed = placed.select(group.alias("key_group"), own.alias("own_key"), "event_id", "ts", *columns)
    schema = f"{key} {kinds[key]}, {out}"
    names = [c.split()[0] for c in schema.split(", ")]
    fold = InOrder(step, state, kinds[key], columns, [kinds[c] for c in columns], names, idle_ms, idle)
    return placed.groupBy("key_group").transformWithStateInPandas(fold, schema, "append", "eventTime")


def _moved(state: tuple | None, event_id: int, us: int, signal: str | None) -> tuple:
    now, fault = state or ("BOOT", 0)
    to, fault = advance(now, fault, signal)
    return (to, fault), (event_id, us, now, to, fault) if to != now else None


def transitions_in_order(signals: DataFrame, late: str, idle_ms: int) -> DataFrame:
    """T1, T18 over a stream of signals (event_id, user_id, ts, signal), whatever files or batches they come in.

    The transitions are those of machine.transitions() over all signals that are no later than `late` behind the newest. A
    device that is silent for more than idle_ms has been turned off: its next signal finds it in BOOT. A null signal
    changes nothing. Lateness, waiting and state as fold_in_order() says.
    """
    out = OUT.removeprefix("user_id long, ")
    return fold_in_order(signals, _moved, "state string, fault int", "user_id", ["signal"], out, late, idle_ms)


def _hit(state: tuple | None, event_id: int, us: int, value: float | None, over: float, n: int) -> tuple:
    run = (state[0] if state else 0) + 1 if value is not None and value > over else 0
    return (run,), (event_id, value, run) if run >= n else None


def consecutive_in_order(readings: DataFrame, over: float, n: int, late: str, idle_ms: int) -> DataFrame:
    """W2, P3 over a stream of readings (event_id, user_id, ts, value): those at least the n-th in a row over a threshold."""
    return fold_in_order(readings, partial(_hit, over=over, n=n), "run long", "user_id", ["value"], "event_id long, value double, run long", late, idle_ms)


def _gated(state: tuple | None, event_id: int, us: int, value: float | None, **limits: float) -> tuple:
    state, found = gate(state, us, value, **limits)
    return state, (event_id, *found)


def credibility_in_order(readings: DataFrame, low: float, high: float, most_rate: float, most_bad: int, late: str, idle_ms: int) -> DataFrame:
    """P1 over a stream of readings: kept, bad and credible as gated.credibility() gives them."""
    step = partial(_gated, low=low, high=high, most_rate=most_rate, most_bad=most_bad)
    out = "event_id long, kept double, bad int, credible boolean"
    return fold_in_order(readings, step, "seen long, kept double, bad int", "user_id", ["value"], out, late, idle_ms)


def _seen(state: tuple | None, event_id: int, us: int) -> tuple:
    return (event_id,), None


def _silent(state: tuple, last: int) -> tuple:
    return state[0], last


def watchdog(readings: DataFrame, ms: int, late: str) -> DataFrame:
    """Each time that a device is silent for more than ms: its last event and when that was, told by a timer on the
    watermark, or by the next event if that comes first."""
    return fold_in_order(readings, _seen, "id long", "user_id", [], "event_id long, silent_since long", late, ms, _silent)
