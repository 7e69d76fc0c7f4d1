"""Column functions for sensor calibration, angles and speeds. All are expressions: nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the device.
ADC_FULL, NTC_R0, NTC_BETA, NTC_T0 = 4095, 10_000.0, 3950.0, 298.15
NTC_OPEN, NTC_SHORT, NTC_MAX_SLOPE = 3900, 200, 3.0
MM_PER_DEGREE = 0.01745329
MICROSTEPS_PER_DEGREE = 200.0 * 32.0 * 14.2857 / 360.0
NOMINAL_RADIUS = 300.0
PULSE_FLOOR_US, PULSE_EXTRA_US = 240, 200_000
LEAST_SPEED, MOST_SPEED = 0.5, 75.0
CONTACT_LOW, CONTACT_HIGH = 20.0, 70.0
ZONES = (("contact", 0.0, 19.0), ("taper", 19.0, 26.0), ("lift", 26.0, 34.0), ("plateau", 34.0, 43.0))
BLOCK_MEANS = (32.0, 26.0, 41.0, 29.0)


def beta_temperature(adc: Column, series_ohm: float = 10_000.0) -> Column:
    """degrees C of a thermistor reading; null where the reading is at either end of the scale."""
    r = series_ohm * adc / (ADC_FULL - adc)
    celsius = 1.0 / (1.0 / NTC_T0 + F.log(r / NTC_R0) / NTC_BETA) - 273.15
    return F.when((adc > 0) & (adc < ADC_FULL), celsius)


def quintic(u: Column) -> Column:
    """the minimum-jerk blend from 0 to 1."""
    return u * u * u * (10.0 + u * (u * 6.0 - 15.0))


def mm_per_degree(radius: Column) -> Column:
    """F3."""
    return radius * MM_PER_DEGREE


def mm_per_microstep(radius: Column) -> Column:
    """F4."""
    return radius * (MM_PER_DEGREE / MICROSTEPS_PER_DEGREE)


def to_microsteps(degrees: Column) -> Column:
    """half away from zero."""
    return F.round(degrees * MICROSTEPS_PER_DEGREE).cast("long")


def to_degrees(microsteps: Column) -> Column:
    """F5, back."""
    return microsteps / MICROSTEPS_PER_DEGREE


def effective_radius(offset: Column) -> Column:
    """an unknown offset is none."""
    return F.coalesce(offset, F.lit(0.0)) + NOMINAL_RADIUS


def segment_time(length: Column, v0: Column, v1: Column, constant: Column, points: int = 32) -> Column:
    """F8: seconds to travel a segment; midpoint rule over 1/v for a blend, v at least LEAST_SPEED."""
    speeds = [F.greatest(v0 + (v1 - v0) * float(u**3 * (10 - 15 * u + 6 * u * u)), F.lit(LEAST_SPEED)) for u in ((i + 0.5) / points for i in range(points))]
    blend = sum((1.0 / s for s in speeds[1:]), 1.0 / speeds[0]) * length / points
    return F.when(constant, length / F.greatest(v0, F.lit(LEAST_SPEED))).otherwise(blend)


def step_interval(mm: Column, speed: Column) -> Column:
    """microseconds between two steps, never under the floor."""
    wanted = F.floor(F.least(mm * 1e6 / speed, F.lit(float(PULSE_FLOOR_US + PULSE_EXTRA_US))))
    return F.greatest(wanted, F.lit(PULSE_FLOOR_US)).cast("long")


def realised_speed(mm: Column, interval_us: Column) -> Column:
    """F10."""
    return mm / (interval_us * 1e-6)


def fnv1a(text: Column) -> Column:
    """the 32-bit checksum of a string's bytes, unsigned."""
    codes = F.transform(F.filter(F.split(F.regexp_replace(F.hex(text), "(..)", "$1 "), " "), lambda h: h != ""), lambda h: F.conv(h, 16, 10).cast("long"))
    step = lambda h, b: (h.bitwiseXOR(b) * 16777619).bitwiseAND(F.lit(4294967295))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), step)


def sine_table(index: Column, amplitude: float) -> Column:
    """the four half waves of a 32-point table."""
    angle = index * (2 * 3.141592653589793 / 32)
    waves = (F.sin(angle), -F.sin(angle), F.cos(angle), -F.cos(angle))
    return F.array(*[F.floor(F.greatest(F.lit(0.0), w) * amplitude).cast("int") for w in waves])


def blink(ms: Column, flashes: int, on_ms: int, off_ms: int, pause_ms: int) -> Column:
    """whether a pattern of some flashes and a pause is lit."""
    at = F.pmod(ms, F.lit(flashes * (on_ms + off_ms) + pause_ms))
    return (at < flashes * (on_ms + off_ms)) & (F.pmod(at, F.lit(on_ms + off_ms)) < on_ms)


def breathing(ms: Column, period_ms: int) -> Column:
    """a raised cosine, squared."""
    return F.pow(0.5 - F.cos(F.pmod(ms, F.lit(period_ms)) * (2 * 3.141592653589793 / period_ms)) * 0.5, 2)


def slow_pwm(ms: Column, duty: Column, period_ms: int = 500, scale: int = 100) -> Column:
    """F15."""
    return F.pmod(ms, F.lit(period_ms)) < F.floor(duty * (period_ms / scale))


def block_mean(block: Column, means: tuple[float, ...] = BLOCK_MEANS) -> Column:
    """F16: null out of range."""
    return F.when((block >= 0) & (block < len(means)), F.element_at(F.array(*map(F.lit, means)), (block + 1).cast("int")))


def drift_wavelength(speed: Column) -> Column:
    """F17."""
    return F.greatest(F.lit(180.0), speed * speed * (0.06 * 6.2832 / 2.0))


def zone(degrees: Column) -> Column:
    """The zone of an angle; null beyond the last."""
    return F.coalesce(*[F.when(F.abs(degrees) <= high, name) for name, _, high in ZONES])


def rail_height(degrees: Column) -> Column:
    """D-20: 0 in contact, a raised cosine over taper and lift, the plateau's height beyond."""
    a, lift, taper = F.abs(degrees), 12.0, 2.67
    ease = lambda u: (1.0 - F.cos(u * 3.141592653589793)) * 0.5
    return F.when(a <= 19, 0.0).when(a <= 26, ease((a - 19.0) / 7.0) * taper).when(a <= 34, ease((a - 26.0) / 8.0) * (lift - taper) + taper).otherwise(lift)


def contact_force(degrees: Column, law: str = "cosine") -> Column:
    """D-21: mN by zone; the taper falls as a raised cosine, or linearly by the other published law."""
    u = (F.abs(degrees) - 19.0) / 7.0
    fall = (1.0 + F.cos(u * 3.141592653589793)) * 200.0 if law == "cosine" else (1.0 - u) * 400.0
    return F.when(F.abs(degrees) <= 19, 400.0).when(F.abs(degrees) <= 26, fall).otherwise(0.0)


def weight_force(mm: Column) -> Column:
    """D-22: mN by the weight's place."""
    return (mm * 40.0 + 4785.0) * 0.040875


def risk(severity: Column, likelihood: Column, detection: Column) -> tuple[Column, Column]:
    """D-23: the product, and the action band; the gravest severity asks for action whatever the product."""
    n = severity * likelihood * detection
    band = F.when((n >= 60) | (severity == 5), "act").when(n >= 40, "reduce").when(n >= 20, "watch").when(n >= 10, "note").otherwise("accept")
    return n, band


def heater_ceiling(volt: Column, ohm: Column, kelvin_per_watt: Column, ambient: Column) -> Column:
    """D-30: the temperature that full power settles at."""
    return ambient + volt * volt / ohm * kelvin_per_watt


def hinge_force_error(degrees: Column) -> Column:
    """D-32: mN."""
    return F.sin(F.radians(degrees)) * 160.0


def stiffness(compression: Column) -> tuple[Column, Column]:
    """D-33: mN per mm, and the ramp's height."""
    return 400.0 / compression, compression / 2.67


def cable_verdict(volt: Column, ampere: Column, ohm: Column) -> tuple[Column, Column]:
    """D-34: what reaches the far end, and whether that is enough."""
    left = volt - ampere * ohm
    return left, F.when(left >= 4.75, "ok").otherwise("brown-out")


def tip_over(mass: Column, distance: Column, height: Column) -> tuple[Column, Column]:
    """D-37: force at the height that tips over an edge, and the angle."""
    return mass * 9.81 * distance / height, F.degrees(F.atan(distance / height))


def wear_band(compression: Column) -> Column:
    """D-43."""
    return F.when(compression < 5.0, "fail").when(compression < 5.5, "warn").otherwise("good")


def counterweight(detent: Column) -> tuple[Column, Column]:
    """D-26: grams that pull a device back with 1.4 times what holds it, by the motor's detent in mN m, and mm of the rod."""
    grams = (detent * 14.2857 + 66.0) * 1.4 / (0.07 * 9.81)
    return grams, grams / 3.85


# What holds the device besides the detent, in mN m, by regime.
REGIMES = (("contact", 48.0), ("taper", 57.0), ("lift", 66.0), ("plateau", 32.0))


def safety_margins(detent: Column, bias: float = 247.0) -> Column:
    """D-26: the bias over what holds the device, for each regime; the least is what limits it."""
    return F.array(*[F.struct((bias / (detent * 14.2857 + more)).alias("margin"), F.lit(name).alias("regime")) for name, more in REGIMES])


def tip_speed(orifice: Column) -> tuple[Column, Column]:
    """D-27: mm/s of the tip by the orifice's diameter, and whether that is in the band."""
    v = F.pow(orifice / 0.75, 2) * 23.0 * 300.0 / 70.0
    return v, F.when(v < 85, "slow").when(v <= 115, "in band").otherwise("fast")


def retract_seconds(degrees: Column, speed: Column, radius: float = 300.0, stop: float = 43.0) -> Column:
    """D-27: the tip's time from an angle to the stop."""
    return F.radians(stop - degrees) * radius / speed
