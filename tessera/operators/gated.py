"""Operators whose next state depends on the last one: a fold over each key's readings in order.

Rows are dealt out by key and sorted within a task, then pass once through a small step function that carries the state
of the key at hand: time is linear, and memory doesn't depend on how long a key's history is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def _folded(batches: Iterator[pa.RecordBatch], step: Callable, key: str, columns: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    now, state, begun = None, None, False
    for batch in batches:
        found = []
        for k, *values in zip(*(batch.column(c).to_pylist() for c in (key, *columns)), strict=True):
            if not begun or k != now:  # a null key is a key like others
                now, state, begun = k, None, True
            state, result = step(state, *values)
            found.append((k, *result))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)


def ordered_fold(df: DataFrame, step: Callable, key: str, order: list[str], columns: list[str], out: str) -> DataFrame:
    """step(state, *columns of a row) -> (state, values of the out columns), row by row of each key in order; the state
    is None at a key's first row. Values are Python's, times as microseconds since 1970, nulls None; rows with a null key
    are those of one key. An empty table gives an empty result. out: the schema of the step's values."""
    micros = {c: F.unix_micros(c) for c, kind in df.dtypes if kind == "timestamp" and c in columns}
    placed = df.select(key, *dict.fromkeys([*order, *columns])).repartition(key).sortWithinPartitions(key, *order)
    rows = placed.select(key, *(micros.get(c, F.col(c)).alias(c) for c in dict.fromkeys(columns)))
    schema = _parse_datatype_string(f"{key} {df.schema[key].dataType.simpleString()}, {out}")
    return rows.mapInArrow(partial(_folded, step=step, key=key, columns=columns, schema=to_arrow_schema(schema)), schema)


def gate(state: tuple | None, us: int | None, value: float | None, low: float, high: float, most_rate: float, most_bad: int) -> tuple:
    """One sample; a null value is refused. Times that are null or equal give no rate, which refuses nothing."""
    seen, kept, bad = state or (None, None, 0)
    timed = us is not None and seen is not None and us != seen
    slow = kept is None or not timed or (value is not None and abs(value - kept) * 1e6 / (us - seen) <= most_rate)
    ok = value is not None and low <= value <= high and slow
    kept, bad = value if ok else kept, 0 if ok else bad + 1
    return (us, kept, bad), (kept, bad, bad < most_bad)


def _gate(state: tuple | None, event_id: int, us: int, value: float | None, **limits: float) -> tuple:
    state, found = gate(state, us, value, **limits)
    return state, (event_id, *found)


def credibility(df: DataFrame, low: float, high: float, most_rate: float, most_bad: int) -> DataFrame:
    """Kept (the last accepted value), bad (refusals in a row), credible. The rate is taken over the time since the
    last sample, accepted or not; the first value in range is accepted, a null value refused."""
    step = partial(_gate, low=low, high=high, most_rate=most_rate, most_bad=most_bad)
    return ordered_fold(df, step, "user_id", ["ts", "event_id"], ["event_id", "ts", "value"], "event_id long, kept double, bad int, credible boolean")


def _control(state: float | None, event_id: int, value: float | None, target: float, hysteresis: float, limit: float, kp: float, gain: float, most_integral: float, most_duty: float) -> tuple:
    integral = state or 0.0
    if value is None:
        return integral, (event_id, integral, 0)
    error = target - value
    if value >= target + hysteresis:
        integral, duty = 0.0 if value >= limit else integral, 0
    else:
        integral = max(0.0, min(most_integral, integral + error * gain))
        duty = int(max(0.0, min(most_duty, error * kp + integral)))
    return integral, (event_id, integral, duty)


def pi_control(df: DataFrame, target: float, hysteresis: float, limit: float, kp: float, ki: float, period_s: float, most_integral: float, most_duty: float) -> DataFrame:
    """Integral (clamped at each step, held over the target, reset over the limit) and duty (a whole number); a null
    value holds the integral and gives no duty."""
    step = partial(_control, target=target, hysteresis=hysteresis, limit=limit, kp=kp, gain=ki * period_s, most_integral=most_integral, most_duty=most_duty)
    return ordered_fold(df, step, "user_id", ["ts", "event_id"], ["event_id", "value"], "event_id long, integral double, duty int")


def _control_state(state: tuple | None, event_id: int, value: float | None, **settings: float) -> tuple:
    integral, found = _control(state[0] if state else None, event_id, value, **settings)
    return (integral,), found


def _control_map(_event, value: float | None, target: float, hysteresis: float, limit: float, gain: float, most_integral: float) -> tuple:
    if value is None or target + hysteresis <= value < limit:
        return 0.0, -math.inf, math.inf
    return (0.0, 0.0, 0.0) if value >= target + hysteresis else ((target - value) * gain, 0.0, most_integral)


def hot_pi_control(df: DataFrame, target: float, hysteresis: float, limit: float, kp: float, ki: float, period_s: float, most_integral: float, most_duty: float, parts: int | None = None) -> DataFrame:
    """W6 as pi_control() gives it, but for the rounding of sums, where a device may have any share of the readings."""
    from tessera.operators.blocked import blocked_fold, clamped_shifts

    own = {"target": target, "hysteresis": hysteresis, "limit": limit, "gain": ki * period_s, "most_integral": most_integral}
    step = partial(_control_state, kp=kp, most_duty=most_duty, **own)
    maps = clamped_shifts(partial(_control_map, **own))
    return blocked_fold(df, step, maps, "user_id", ["ts", "event_id"], ["event_id", "value"], "event_id long, integral double, duty int", parts)


def _ou(state: tuple[int, float] | None, noise: float | None, mean: float, keep: float, spread: float, low: float, high: float) -> tuple:
    k, x = state or (0, mean)
    x = mean + (x - mean) * keep + (noise or 0.0) * spread
    x = high - abs((x - low) % (2 * (high - low)) - (high - low))
    return (k + 1, x), (k + 1, x)


def ou_steps(df: DataFrame, mean: float, sigma: float, tau: float, low: float, high: float) -> DataFrame:
    """K (from 1) and x of each user's bounded mean-reverting path that df's noise drives; a null noise is none."""
    a = math.exp(-1.0 / tau)
    step = partial(_ou, mean=mean, keep=a, spread=sigma * math.sqrt(1 - a * a), low=low, high=high)
    return ordered_fold(df, step, "user_id", ["ts", "event_id"], ["noise"], "k long, x double")
