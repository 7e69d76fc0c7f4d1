"""Small reference tables: parameters, seeds, codes, transitions and published measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Axis, tau (strokes), mean, sigma, low, high; the bench set differs on two axes.
FIRMWARE = {
    "velocity": (6.0, 32.0, 8.0, 20.0, 70.0), "gap": (4.0, 3.5, 1.1, 1.5, 5.5), "ramp": (5.0, 1.4, 0.55, 0.6, 2.5),
    "turnaround": (3.0, 38.0, 1.6, 35.0, 41.0), "graze": (4.0, 22.5, 0.8, 20.75, 23.40), "radius": (8.0, 0.0, 9.0, -24.0, 24.0),
}
BENCH = FIRMWARE | {"turnaround": (3.0, 36.5, 1.6, 33.5, 39.5), "graze": (4.0, 22.5, 1.2, 20.5, 24.5)}
PARAMETERS = {"firmware": FIRMWARE, "bench": BENCH}
BLOCK_MEANS = (32.0, 26.0, 41.0, 29.0)

# The seed in place of 0, and the first seed and the step of a batch.
FALLBACK_SEED, FIRST_SEED, SEED_STEP = 0x1BADC0DE, 0x1000, 2654435761

# Preset, weight mm, block means, sigma, tau, log mode, least and most gap, flight speed, graze share, least and most jump.
PRESETS = [
    ("base", 125, [3.2, 2.6, 4.1, 2.9], 0.80, 6, False, 1.5, 5.5, 8.0, 0.15, 6, 12),
    ("soft", 76, [2.9, 2.5, 3.3, 2.7], 0.50, 8, True, 2.5, 6.5, 7.0, 0.30, 6, 10),
    ("intense", 168, [3.6, 3.0, 4.6, 3.4], 1.00, 5, False, 1.5, 4.0, 9.0, 0.05, 7, 14),
    ("slow", 125, [2.6, 2.3, 3.0, 2.4], 0.45, 9, True, 3.5, 7.0, 5.0, 0.15, 6, 12),
]

# Fault codes.
FAULTS = dict(enumerate((
    "none", "driver version", "driver silent", "tuning", "microsteps changed", "homing", "integrity", "drift", "stall", "ferrule sensor", "cup sensor",
    "over-temperature", "rail dead", "brown-out", "clock", "driver error", "watchdog",
)))

# State, signal, next state, fault code (0: none).
TRANSITIONS = [
    ("BOOT", "configured", "AUTOTUNE", 0), ("BOOT", "bad_version", "FAULT", 1), ("BOOT", "driver_error", "FAULT", 15),
    ("AUTOTUNE", "tuned", "HOMING", 0), ("AUTOTUNE", "not_tuned", "FAULT", 3), ("HOMING", "home", "IDLE", 0), ("HOMING", "no_home", "FAULT", 5),
    ("IDLE", "armed", "PREWARM", 0), ("PREWARM", "warm", "RUNNING", 0), ("PREWARM", "integrity", "FAULT", 6), ("PREWARM", "unsafe", "FAULT", 12),
    ("RUNNING", "unsafe", "FAULT", 12), ("RUNNING", "full", "RETREAT", 0), ("RUNNING", "stall", "RETREAT", 8), ("RUNNING", "overtime", "RETREAT", 14),
    ("RUNNING", "microsteps", "FAULT", 4), ("RETREAT", "parked", "IDLE", 0), ("RUNNING", "integrity", "FAULT", 6),
    ("PREWARM", "ferrule_sensor", "FAULT", 9), ("RUNNING", "ferrule_sensor", "FAULT", 9),
    ("PREWARM", "cup_sensor", "FAULT", 10), ("RUNNING", "cup_sensor", "FAULT", 10),
    ("PREWARM", "over_temperature", "FAULT", 11), ("RUNNING", "over_temperature", "FAULT", 11),
    ("PREWARM", "brown_out", "FAULT", 13), ("RUNNING", "brown_out", "FAULT", 13),
]

# Degrees C and reading of a thermistor.
THERMISTOR = [(15, 2506), (18, 2378), (20, 2277), (22, 2189), (24, 2093), (28, 1899), (30, 1806), (33, 1696), (36, 1576), (38, 1495), (45, 1235)]
# weight's place in mm and force in mN.
WEIGHT_SCALE = [(40, 261), (60, 294), (80, 326), (100, 359), (110, 375), (120, 392), (125, 400), (130, 408), (140, 424), (160, 457), (180, 490), (200, 523)]
# Mean asked for, then mean, deviation, mean step and share at the edge of the bounded process.
OU_MOMENTS = [(2.6, 2.895, 0.600, 0.325, 9.1), (2.9, 3.074, 0.661, 0.334, 5.8), (3.0, 3.157, 0.681, 0.338, 4.8), (3.2, 3.304, 0.711, 0.342, 3.3), (4.1, 4.112, 0.785, 0.353, 0.3)]
# Severity, likelihood, detection of 39 risks, the printed product, and the same after measures.
RISKS = [
    (5, 3, 5, 75, 5, 2, 2, 20), (4, 3, 5, 60, 4, 1, 2, 8), (2, 5, 5, 50, 2, 3, 2, 12), (4, 3, 4, 48, 4, 2, 1, 8), (3, 4, 4, 48, 3, 3, 2, 18),
    (5, 2, 4, 40, 5, 1, 2, 10), (5, 2, 4, 40, 5, 1, 2, 10), (5, 2, 4, 40, 5, 1, 3, 15), (4, 3, 3, 36, 4, 2, 1, 8), (3, 4, 3, 36, 3, 3, 2, 18),
    (3, 3, 3, 27, 3, 2, 2, 12), (3, 2, 4, 24, 3, 1, 2, 6), (3, 2, 4, 24, 3, 1, 1, 3), (3, 2, 4, 24, 3, 1, 2, 6), (3, 2, 4, 24, 3, 1, 2, 6),
    (3, 4, 2, 24, 3, 3, 1, 9), (3, 2, 3, 18, 3, 1, 2, 6), (2, 3, 3, 18, 2, 2, 1, 4), (2, 3, 3, 18, 2, 2, 2, 8), (2, 3, 3, 18, 2, 2, 1, 4),
    (4, 2, 2, 16, 4, 1, 2, 8), (5, 1, 4, 20, 5, 1, 1, 5), (5, 1, 2, 20, 5, 1, 1, 5), (4, 2, 1, 8, 4, 1, 1, 4), (2, 3, 1, 6, 2, 3, 1, 6),
    (1, 2, 1, 2, 1, 2, 1, 2), (1, 2, 1, 2, 1, 2, 1, 2), (1, 4, 3, 12, 1, 3, 1, 3), (2, 2, 2, 8, 2, 1, 1, 2), (3, 3, 2, 18, 3, 2, 2, 12),
    (4, 1, 4, 16, 4, 1, 2, 8), (1, 3, 2, 6, 1, 2, 1, 2), (5, 3, 4, 60, 5, 1, 2, 10), (5, 3, 4, 60, 5, 1, 2, 10), (4, 3, 4, 48, 4, 1, 2, 8),
    (4, 2, 4, 32, 4, 1, 2, 8), (3, 4, 3, 36, 3, 3, 2, 18), (5, 1, 3, 15, 5, 1, 1, 5), (2, 2, 3, 12, 2, 1, 1, 2),
]
# Block, quantities and unit prices in cents of 43 parts.
PARTS = {
    "electronics": [(1, 900), (1, 550), (1, 450), (1, 180), (1, 220), (1, 120), (1, 300), (1, 100), (1, 40), (1, 15), (1, 260), (1, 130), (1, 400), (1, 350), (1, 800)],
    "mechanics": [(2, 55), (2, 60), (1, 40), (1, 120), (1, 80), (1, 60), (1, 300), (1, 350), (2, 120), (4, 60)],
    "structure": [(1, 750), (1, 300), (1, 650), (1, 250), (1, 400), (1, 250), (1, 150), (1, 300), (1, 200), (1, 250), (1, 550)],
    "contact": [(2, 800), (1, 120), (1, 400)],
    "finish": [(1, 400), (1, 300), (1, 750), (1, 450)],
}


def parameters(spark: SparkSession) -> DataFrame:
    rows = [(s, axis, *v) for s, axes in PARAMETERS.items() for axis, v in axes.items()]
    return spark.createDataFrame(rows, "param_set string, axis string, tau double, mean double, sigma double, low double, high double")


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, "preset string, weight_mm int, means array<double>, sigma double, tau int, log_mode boolean, gap_low double, gap_high double, flight double, graze double, jump_low int, jump_high int")


def seeds(spark: SparkSession, n: int = 200) -> DataFrame:
    """session_id and seed: FIRST_SEED + k * SEED_STEP, modulo 2 to the 32nd."""
    return spark.range(n).select(F.col("id").alias("session_id"), ((F.col("id") * SEED_STEP + FIRST_SEED) % 4294967296).alias("seed"))


def faults(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FAULTS.items()), "code int, meaning string")


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRANSITIONS, "state string, signal string, next string, fault int")


def thermistor(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(THERMISTOR, "celsius int, adc int")


def weight_scale(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WEIGHT_SCALE, "mm int, mn int")


def ou_moments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OU_MOMENTS, "asked double, mean double, sd double, step double, edge_pct double")


def risks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"R-{k + 1:02d}", *r) for k, r in enumerate(RISKS)], "id string, s int, p int, d int, printed int, s2 int, p2 int, d2 int, printed2 int")


def parts(spark: SparkSession) -> DataFrame:
    rows = [(block, k + 1, q, c) for block, own in PARTS.items() for k, (q, c) in enumerate(own)]
    return spark.createDataFrame(rows, "block string, line int, quantity int, unit_cents int")
