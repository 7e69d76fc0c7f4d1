"""Motion profiles as arrays of segments: expressions that build, time and expand them.

A segment is a struct (s0, s1, v0, v1, constant): travel from s0 to s1 mm at v0, or blended from v0 to v1. Times are
integrals of 32 points, inside a bisection of 20 rounds for an entry speed: as expressions over arrays Spark would
interpret these point by point, so they are worked out for whole Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import sensor

START_SPEED, FLIGHT_SPEED, FLIGHT_ACCELERATION = 6.0, 75.0, 200.0
CONTACT_DEG, TAPER_DEG = 19.0, 26.0
ENTRY_LEAST, ENTRY_MOST = 5.0, 70.0
MOST_SEGMENTS, SHORTEST = 10, 0.01
#: Profiles that a task expands at most, on average.
PROFILES = 20_000


def segment(s0: Column, s1: Column, v0: Column, v1: Column, constant: bool = False) -> Column:
    return F.struct(s0.alias("s0"), s1.alias("s1"), v0.cast("double").alias("v0"), v1.cast("double").alias("v1"), F.lit(constant).alias("constant"))


def tidy(segments: Column) -> Column:
    """Without segments that are too short; ten at most."""
    return F.slice(F.filter(segments, lambda x: x["s1"] > x["s0"] + SHORTEST), 1, MOST_SEGMENTS)


def flight(s0: Column, s1: Column, v0: Column, v1: Column) -> Column:
    """Accelerate, cruise, brake off the surface; one blend where there is no room for a cruise."""
    up = (FLIGHT_SPEED**2 - v0 * v0) / (2 * FLIGHT_ACCELERATION)
    down = (FLIGHT_SPEED**2 - v1 * v1) / (2 * FLIGHT_ACCELERATION)
    fast = F.lit(FLIGHT_SPEED)
    whole = F.array(segment(s0, s1, v0, v1))
    three = F.array(segment(s0, s0 + up, v0, fast), segment(s0 + up, s1 - down, fast, fast, True), segment(s1 - down, s1, fast, v1))
    return F.when(((v0 >= FLIGHT_SPEED) & (v1 >= FLIGHT_SPEED)) | (up + down >= s1 - s0), whole).otherwise(three)


def simple_move(distance: Column, speed: Column) -> Column:
    """A move off the surface with a ramp at either end; null where the distance or the speed is."""
    ramp = F.least(distance * 0.2, F.lit(20.0))
    slow = F.least(F.lit(START_SPEED), speed)
    zero = F.lit(0.0)
    two = F.array(segment(zero, distance * 0.5, slow, speed), segment(distance * 0.5, distance, speed, slow))
    three = F.array(segment(zero, ramp, slow, speed), segment(ramp, distance - ramp, speed, speed, True), segment(distance - ramp, distance, speed, slow))
    return F.when(distance.isNotNull() & speed.isNotNull(), tidy(F.when(distance <= ramp * 2 + 0.5, two).otherwise(three)))


def _blend_seconds(length: np.ndarray, v0: np.ndarray, v1: np.ndarray, points: int = 32) -> np.ndarray:
    """F8 of rows of blended segments."""
    u = (np.arange(points) + 0.5) / points
    speed = np.maximum(v0[:, None] + (v1 - v0)[:, None] * (u**3 * (10 - 15 * u + 6 * u * u)), sensor.LEAST_SPEED)
    return (1.0 / speed).sum(1) * length / points


def _times(segments: pa.Array, after: np.ndarray) -> pa.Array:
    """Seconds from a place of each profile on; what is left of a segment there keeps its speeds. Null for a null profile."""
    parts, owner = segments.flatten(), np.asarray(pc.list_parent_indices(segments))
    s0, s1, v0, v1 = (np.asarray(parts.field(c)).astype(float) for c in ("s0", "s1", "v0", "v1"))
    constant = np.asarray(parts.field("constant").cast(pa.int8())) > 0
    begin = np.maximum(s0, after[owner])
    length = np.where(s1 > after[owner] + SHORTEST, s1 - begin, 0.0)
    length = np.where(np.isinf(after[owner]) | (length > SHORTEST), length, 0.0)
    seconds = np.where(constant, length / np.maximum(v0, sensor.LEAST_SPEED), _blend_seconds(length, v0, v1))
    total = np.bincount(owner, seconds, len(segments)) if len(owner) else np.zeros(len(segments))
    return pa.array(total, mask=~np.asarray(segments.is_valid(), bool))


def plan_time(segments: Column) -> Column:
    """Null for a null profile, 0 for one without segments."""

    def seconds(s: pa.Array) -> pa.Array:
        return _times(s, np.full(len(s), -np.inf))

    return F.arrow_udf(seconds, "double")(segments)


def air_time(segments: Column, air_from: Column) -> Column:
    """The time after a place; a null place is never reached."""

    def seconds(s: pa.Array, a: pa.Array) -> pa.Array:
        return _times(s, np.nan_to_num(np.asarray(a.cast(pa.float64()).to_numpy(zero_copy_only=False)), nan=np.finfo(float).max))

    return F.coalesce(F.arrow_udf(seconds, "double")(segments, air_from), F.lit(0.0))


def entry_speed(taper_mm: Column, cruise: Column, seconds: Column, rounds: int = 20) -> Column:
    """The speed at which a taper takes the wanted time, by bisection; the bound where none does. Null if an input is."""

    def found(length: pd.Series, cruise: pd.Series, wanted: pd.Series) -> pd.Series:
        length, cruise, wanted = (x.to_numpy(float, na_value=np.nan) for x in (length, cruise, wanted))
        time_at = lambda v: _blend_seconds(length, v, cruise)
        low, high = np.full(len(length), ENTRY_LEAST), np.full(len(length), ENTRY_MOST)
        slowest, fastest = time_at(low), time_at(high)
        for _ in range(rounds):
            middle = (low + high) * 0.5
            slow = time_at(middle) > wanted
            low, high = np.where(slow, middle, low), np.where(slow, high, middle)
        speed = np.where(wanted >= slowest, ENTRY_LEAST, np.where(wanted <= fastest, ENTRY_MOST, (low + high) * 0.5))
        missing = np.isnan(length) | np.isnan(cruise) | np.isnan(wanted)
        return pd.Series(np.where(missing, np.nan, speed)).astype("Float64").mask(missing)

    return F.pandas_udf(found, "double")(taper_mm, cruise, seconds)


def with_stroke(df: DataFrame) -> DataFrame:
    """G1: adds entry, segments, contact_from, contact_to and air_from (null: it ends grazing) to strokes.

    df has from_deg, to_deg, cruise, ramp_s, radius and graze (whether the stroke ends grazing); it begins grazing if
    from_deg is within the taper.
    """
    k = sensor.mm_per_degree(F.col("radius"))
    df = df.withColumn("entry", entry_speed(k * (TAPER_DEG - CONTACT_DEG), F.col("cruise"), F.col("ramp_s")))
    side = F.when(F.col("from_deg") >= 0, 1.0).otherwise(-1.0)
    at = lambda deg: F.abs(deg - F.col("from_deg")) * k
    far, zero, cruise, entry, slow = at(F.col("to_deg")), F.lit(0.0), F.col("cruise"), F.col("entry"), F.lit(START_SPEED)
    c0, c1, t0, t1 = at(side * CONTACT_DEG), at(side * -CONTACT_DEG), at(side * TAPER_DEG), at(side * -TAPER_DEG)
    land = F.concat(flight(zero, t0, slow, entry), F.array(segment(t0, c0, entry, cruise)))
    lift = F.concat(F.array(segment(c1, t1, cruise, entry)), flight(t1, far, entry, slow))
    head = F.when(F.abs("from_deg") < TAPER_DEG, F.array(segment(zero, c0, slow, cruise))).otherwise(land)
    tail = F.when(F.col("graze"), F.array(segment(c1, far, cruise, slow))).otherwise(lift)
    segments = tidy(F.concat(head, F.array(segment(c0, c1, cruise, cruise, True)), tail))
    return df.withColumns({"segments": segments, "contact_from": c0, "contact_to": c1, "air_from": F.when(~F.col("graze"), t1)})


def graze_turn(from_deg: Column, degrees: Column, model: str = "far") -> Column:
    """D-7: where a grazing stroke turns: across the contact in the far taper, or, by the other model, on the side it came
    from, without ever being in full contact."""
    side = F.when(from_deg >= 0, 1.0).otherwise(-1.0)
    return side * F.abs(degrees) if model == "same" else -side * F.abs(degrees)


def move_limit_ms(distance: Column, speed: Column) -> Column:
    """Milliseconds that a move may take at most: three times what its speed gives, at least 1 mm/s, and 4 s."""
    return F.floor(distance / F.greatest(speed, F.lit(1.0)) * 3000).cast("long") + 4000


def speed_at(segments: Column, s: Column, drift: Column | None = None, contact_from: Column | None = None, contact_to: Column | None = None) -> Column:
    """The speed at a place: of the first segment that ends there or later, else the last.

    drift: a factor within contact, where the result stays in the contact band.
    """
    x = F.coalesce(F.get(F.filter(segments, lambda g: s <= g["s1"]), F.lit(0)), F.try_element_at(segments, F.lit(-1)))
    length = x["s1"] - x["s0"]
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(length > 0.001, (s - x["s0"]) / length).otherwise(1.0)))
    v = F.when(x["constant"], x["v0"]).otherwise(x["v0"] + (x["v1"] - x["v0"]) * sensor.quintic(u))
    if drift is not None:
        v = F.when((s >= contact_from) & (s <= contact_to), F.greatest(F.lit(sensor.CONTACT_LOW), F.least(F.lit(sensor.CONTACT_HIGH), v * drift))).otherwise(v)
    return F.greatest(F.lit(sensor.LEAST_SPEED), F.least(F.lit(sensor.MOST_SPEED), v))


def _last_step(mm: Column, s: Column) -> Column:
    """The last i with i * mm <= s."""
    i = F.floor(s / mm).cast("int")
    return F.when((i + 1) * mm <= s, i + 1).when(i * mm > s, i - 1).otherwise(i)


def tasks(df: DataFrame) -> int:
    """Tasks to expand the profiles of df: as many as there are cores, and more with their number."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // PROFILES))


def expand(df: DataFrame, segments: str, radius: str) -> DataFrame:
    """A row for each microstep: i, s, speed, interval_us, realised. Rows of a profile stay in its task.

    Each segment makes its own steps, so nothing looks a segment up step by step. A null profile or radius, or one
    without segments, has no steps.
    """
    x = F.col("_x")
    own = df.filter(F.try_element_at(F.col(segments), F.lit(-1))["s1"].isNotNull()).withColumn("mm", sensor.mm_per_microstep(F.col(radius))).withColumn("_n", F.greatest(F.round(F.try_element_at(F.col(segments), F.lit(-1))["s1"] / F.col("mm")).cast("int"), F.lit(1)))
    own = own.select("*", F.posexplode(segments).alias("_k", "_x"))
    before = _last_step(F.col("mm"), F.get(F.col(segments), F.col("_k") - 1)["s1"])
    own = own.withColumns({
        "_low": F.when(F.col("_k") == 0, 1).otherwise(before + 1),
        "_high": F.when(F.col("_k") == F.size(segments) - 1, F.col("_n")).otherwise(F.least(_last_step(F.col("mm"), x["s1"]), F.col("_n"))),
    })
    steps = own.filter("_low <= _high").withColumn("i", F.explode(F.sequence("_low", "_high"))).withColumn("s", F.col("i") * F.col("mm"))
    length = x["s1"] - x["s0"]
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(length > 0.001, (F.col("s") - x["s0"]) / length).otherwise(1.0)))
    v = F.when(x["constant"], x["v0"]).otherwise(x["v0"] + (x["v1"] - x["v0"]) * sensor.quintic(u))
    steps = steps.withColumn("speed", F.greatest(F.lit(sensor.LEAST_SPEED), F.least(F.lit(sensor.MOST_SPEED), v)))
    steps = steps.withColumn("interval_us", sensor.step_interval(F.col("mm"), F.col("speed")))
    return steps.withColumn("realised", sensor.realised_speed(F.col("mm"), F.col("interval_us"))).drop("_k", "_x", "_n", "_low", "_high")
