"""Ramps into and out of a session, and bands of measured figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds of the session and of its ramps; shares of grazing strokes at the beginning, in between and at the end.
SESSION_S, RAMP_IN_S, RAMP_OUT_S = 900.0, 50.0, 60.0
GRAZE_IN, GRAZE, GRAZE_OUT = 0.70, 0.15, 0.80
# Least and most mN of a grazing stroke at the ends, and in between.
FORCE_END, FORCE = 150.0, 300.0
# Mm of sideways drift over 100 mm up to which a hinge is judged so.
DRIFT_BANDS = ((3.5, "excellent"), (5.2, "accepted"), (8.7, "limit"))
# Surface and the degrees C that it may reach.
SURFACES = (("hair", 40.0), ("ferrule", 43.0), ("cup", 40.0), ("column", 50.0))


def graze_share(t: Column) -> Column:
    """D-9: the share of grazing strokes at t seconds: falls over the first ramp, rises over the last."""
    into, out = t / RAMP_IN_S, (t - (SESSION_S - RAMP_OUT_S)) / RAMP_OUT_S
    return F.when(t < RAMP_IN_S, (GRAZE - GRAZE_IN) * into + GRAZE_IN).when(t > SESSION_S - RAMP_OUT_S, (GRAZE_OUT - GRAZE) * out + GRAZE).otherwise(GRAZE)


def graze_force(t: Column) -> tuple[Column, Column]:
    """D-9: least and most mN of a grazing stroke at t seconds: the most rises with the first ramp and falls with the last,
    where the least is 50 below it, but for the least of all."""
    into, out = t / RAMP_IN_S, (t - (SESSION_S - RAMP_OUT_S)) / RAMP_OUT_S
    most = F.when(t < RAMP_IN_S, (FORCE - FORCE_END) * into + FORCE_END).when(t > SESSION_S - RAMP_OUT_S, FORCE - (FORCE - FORCE_END) * out).otherwise(FORCE)
    least = F.when(t > SESSION_S - RAMP_OUT_S, F.greatest(F.lit(FORCE_END), most - 50.0)).otherwise(FORCE_END)
    return least, most


def drift_verdict(mm: Column) -> Column:
    """D-32: a hinge's verdict by its measured sideways drift."""
    band = F.when(mm.isNull(), None)
    for most, name in DRIFT_BANDS:
        band = band.when(mm <= most, name)
    return band.otherwise("rejected")


def drift_factor(s: Column, contact_from: Column, amplitude: float, length: float, phase: Column) -> Column:
    """the factor by which the speed drifts within contact, a sine over the way."""
    return F.sin((s - contact_from) * (2 * 3.141592653589793 / length) + phase) * amplitude + 1.0
