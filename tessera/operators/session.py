"""Seeded sessions: one shared generator decides draw by draw, so a session is sequential and sessions run in parallel.

The Python part only draws and keeps the clock; profiles, statistics and checks over the strokes are Spark's.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources import golden

SESSION_S, RESERVE_S, BLOCK_S, MOST_GAP_S, GRAZE_GAP_S = 900.0, 40.0, 225.0, 10.0, 0.25
CARRIAGE_MM_S, APART_MM, MOVE_EVERY, GRAZE_SHARE, REST_DEG = 1.953125, 6.0, 4, 0.15, 43.0
STROKES = "session_id long, n int, t_s double, kind string, cruise double, radius double, target double, guide double, seconds double, gap_s double, dwell_s double, from_deg double, to_deg double, waited boolean"
_U = (np.arange(32) + 0.5) / 32
_BLEND = _U**3 * (10 + _U * (6 * _U - 15))


class Draws:
    """The generator with its cached normal deviate, and the six bounded walks."""

    def __init__(self, seed: int, axes: dict[str, tuple]) -> None:
        self.state, self.spare, self.axes = seed or golden.FALLBACK_SEED, None, axes
        self.at = {a: v[1] for a, v in axes.items()}

    def uniform(self) -> float:
        x = self.state
        x ^= x << 13 & 0xFFFFFFFF
        x ^= x >> 17
        self.state = x = x ^ (x << 5 & 0xFFFFFFFF)
        return (x >> 8) / 16777216

    def normal(self) -> float:
        if self.spare is not None:
            z, self.spare = self.spare, None
            return z
        r = math.sqrt(-2 * math.log(max(self.uniform(), 1e-7)))
        turn = 2 * math.pi * self.uniform()
        self.spare = r * math.sin(turn)
        return r * math.cos(turn)

    def walk(self, axis: str, mean: float | None = None) -> float:
        tau, mu, sigma, low, high = self.axes[axis]
        mu, a = mu if mean is None else mean, math.exp(-1 / tau)
        x = mu + (self.at[axis] - mu) * a + sigma * math.sqrt(1 - a * a) * self.normal()
        self.at[axis] = high - abs((x - low) % (2 * (high - low)) - (high - low))
        return self.at[axis]


def _seconds(length: float, v0: float, v1: float) -> float:
    return length * float(np.mean(1 / np.maximum(v0 + (v1 - v0) * _BLEND, 0.5))) if length > 0.01 else 0.0


def _flight(length: float, v: float) -> float:
    """G2 in time: from rest speed to v, with a cruise if there is room."""
    up, down = (75.0**2 - 6.0**2) / 400, (75.0**2 - v * v) / 400
    return _seconds(length, 6.0, v) if up + down >= length else _seconds(up, 6.0, 75.0) + (length - up - down) / 75 + _seconds(down, 75.0, v)


def _entry(taper: float, cruise: float, wanted: float) -> float:
    low, high = 5.0, 70.0
    if wanted >= _seconds(taper, low, cruise):
        return low
    if wanted <= _seconds(taper, high, cruise):
        return high
    for _ in range(20):
        mid = (low + high) / 2
        low, high = (mid, high) if _seconds(taper, mid, cruise) > wanted else (low, mid)
    return (low + high) / 2


def _session(rows: pd.DataFrame, axes: dict[str, tuple]) -> pd.DataFrame:
    """T17 with T3, T4, T8-T11, P4, P5, K1: the strokes of each seed."""
    out = []
    for session_id, seed in zip(rows["session_id"], rows["seed"], strict=True):
        d, t, angle, grazed, visits, n = Draws(int(seed), axes), 0.0, REST_DEG, False, 1, 0
        place = goal = 0.0
        past: list[float] = []
        while True:
            if visits < 4 and t >= visits * BLOCK_S:  # T3: back to the cup at the end of a block
                length = abs(REST_DEG - angle) * (300 + place) * 0.01745329
                dt = 2.5 + _seconds(length / 5, 6.0, 26.0) * 2 + length * 0.6 / 26
                place += max(-CARRIAGE_MM_S * dt, min(CARRIAGE_MM_S * dt, goal - place))
                t, angle, visits, grazed = t + dt, REST_DEG, visits + 1, False
                continue
            block, mm = min(3, int(t // BLOCK_S)), (300 + place) * 0.01745329
            cruise, ramp = d.walk("velocity", golden.BLOCK_MEANS[block]), d.walk("ramp")
            graze = not grazed and block > 0 and angle >= 0 and d.uniform() < GRAZE_SHARE
            size = d.walk("graze" if graze else "turnaround")
            end = -size if angle >= 0 else size
            d.uniform()  # the drift's phase
            v, begins = _entry(7 * mm, cruise, ramp), abs(angle) < 26
            land = _seconds((abs(angle) - 19) * mm, 6.0, cruise) if begins else _flight((abs(angle) - 26) * mm, v) + _seconds(7 * mm, v, cruise)
            air = 0.0 if graze else _flight((size - 26) * mm, v)
            lift = _seconds((size - 19) * mm, cruise, 6.0) if graze else _seconds(7 * mm, cruise, v) + air
            contact = 38 * mm / cruise
            seconds = land + contact + lift
            if t + seconds + RESERVE_S >= SESSION_S:  # P5
                break
            radius, target, guide, moved = 300 + place, None, None, 0.0
            if not graze and n % MOVE_EVERY == 0:
                guide = d.walk("radius")
                fit = [c for s in (-1, 1) for k in range(13) if -24 <= (c := place + s * (6 + k / 2)) <= 24 and all(abs(c - h) >= APART_MM for h in past)]
                if fit:
                    before = land + 0.8 * contact  # the carriage starts late in the contact
                    place += max(-CARRIAGE_MM_S * before, min(CARRIAGE_MM_S * before, goal - place))
                    target = min(fit, key=lambda c: abs(c - guide))
                    past, goal, moved = [radius - 300, *past][:2], target, before
            place += max(-CARRIAGE_MM_S * (seconds - moved), min(CARRIAGE_MM_S * (seconds - moved), goal - place))
            began, t, gap, dwell, waited = t, t + seconds, None, GRAZE_GAP_S, False
            if not graze:
                gap = d.walk("gap")
                dwell = max(0.0, gap - 2 * air)  # T9
                busy = abs(goal - place) / CARRIAGE_MM_S
                waited = busy > dwell
                dwell = min(max(dwell, busy), MOST_GAP_S)  # T8
            dwell = max(0.0, min(dwell, SESSION_S - RESERVE_S - t))
            place += max(-CARRIAGE_MM_S * dwell, min(CARRIAGE_MM_S * dwell, goal - place))
            out.append((session_id, n, began, "graze" if graze else "full", cruise, radius, target, guide, seconds, gap, dwell, angle, end, waited))
            t, angle, grazed, n = t + dwell, end, graze, n + 1
    return pd.DataFrame(out, columns=[c.split()[0] for c in STROKES.split(", ")])


def simulate(seeds: DataFrame, param_set: str = "firmware") -> DataFrame:
    """The strokes of each seed's session (session_id, seed), as the parameter set has them."""
    return seeds.groupBy("session_id").applyInPandas(partial(_session, axes=golden.PARAMETERS[param_set]), STROKES)


def report(strokes: DataFrame) -> DataFrame:
    """A2-A4: a row of figures for each session."""
    s = F.col
    return strokes.groupBy("session_id").agg(
        F.count("*").alias("strokes"), F.count_if(s("kind") == "graze").alias("grazes"), F.count("target").alias("carriage_moves"), F.count_if(s("waited")).alias("gaps_stretched"),
        F.min("cruise").alias("v_low"), F.max("cruise").alias("v_high"), F.min("gap_s").alias("gap_low"), F.max("gap_s").alias("gap_high"), F.max("dwell_s").alias("dwell_high"),
        F.sum(s("radius") * (38 * 0.01745329)).alias("path_mm"), F.max(s("t_s") + s("seconds") + s("dwell_s")).alias("t_final"),
    )
