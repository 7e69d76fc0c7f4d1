"""Seeded random sequences and bounded mean-reverting processes as expressions on longs and arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 4294967295


def _without_first(path: Column) -> Column:
    return F.slice(path, F.lit(2), F.size(path))


def xorshift32(x: Column) -> Column:
    """The next state; zero stays zero, so seeds must not be."""
    x = x.bitwiseXOR(F.shiftleft(x, 13).bitwiseAND(F.lit(MASK)))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 17))
    return x.bitwiseXOR(F.shiftleft(x, 5).bitwiseAND(F.lit(MASK)))


def xorshift_states(seed: Column, n: int) -> Column:
    """The first n states after a seed, as an array."""
    grow = lambda a, _: F.concat(a, F.array(xorshift32(F.element_at(a, -1))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.array(seed.cast("long")), grow, _without_first)


def uniform(state: Column) -> Column:
    """R2: [0, 1) from the upper 24 bits."""
    return F.shiftrightunsigned(state, 8) / 16777216.0


def normals(states: Column) -> Column:
    """Pairs of states to pairs of normal deviates (Box-Muller), in order."""
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(states) / 2).cast("int") - 1), lambda k: F.struct(F.greatest(uniform(F.get(states, k * 2)), F.lit(1e-7)).alias("a"), uniform(F.get(states, k * 2 + 1)).alias("b")))
    radius = lambda p: F.sqrt(F.log(p["a"]) * -2.0)
    both = lambda p: F.array(radius(p) * F.cos(p["b"] * (2 * math.pi)), radius(p) * F.sin(p["b"] * (2 * math.pi)))
    return F.flatten(F.transform(pairs, both))


def reflect(x: Column, low: Column | float, high: Column | float) -> Column:
    """X folded back into [low, high] as often as needed: a triangle wave."""
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    span = high - low
    return high - F.abs(F.pmod(x - low, span * 2.0) - span)


def ou_path(noise: Column, mean: float, sigma: float, tau: float, low: float, high: float, start: float | None = None) -> Column:
    """The bounded mean-reverting path that an array of unit noise drives, as an array of the same length."""
    a = math.exp(-1.0 / tau)
    spread = sigma * math.sqrt(1 - a * a)
    first = F.array(F.lit(float(mean if start is None else start)))
    step = lambda path, e: F.concat(path, F.array(reflect((F.element_at(path, -1) - mean) * a + mean + e * spread, low, high)))
    return F.aggregate(noise, first, step, _without_first)


def log_ou_path(noise: Column, mean: float, sigma: float, tau: float, low: float, high: float) -> Column:
    """D-1: the same over logarithms; sigma is that of the logarithm."""
    return F.transform(ou_path(noise, math.log(mean), sigma, tau, math.log(low), math.log(high)), F.exp)


def integer_ou_path(noise: Column, mean: int, keep_q16: int, spread_q16: int, low: int, high: int) -> Column:
    """D-2: in whole numbers with factors in parts of 65536; noise: whole numbers of mean 0."""
    fold = lambda x: F.lit(high) - F.abs(F.pmod(x - low, F.lit(2 * (high - low))) - (high - low))
    step = lambda path, e: F.concat(path, F.array(fold(F.lit(mean) + F.shiftright((F.element_at(path, -1) - mean) * keep_q16, 16) + F.shiftright(e * spread_q16, 16)).cast("long")))
    return F.aggregate(noise, F.array(F.lit(mean).cast("long")), step, _without_first)


def cascade(paths: list[Column]) -> Column:
    """D-18: the sum of processes of several time constants, place by place."""
    out = paths[0]
    for p in paths[1:]:
        out = F.zip_with(out, p, lambda a, b: a + b)
    return out


def _times32(a: Column, b: int) -> Column:
    """a * b modulo 2 to the 32nd without leaving 63 bits."""
    return (a * (b & 0xFFFF) + F.shiftleft((a * (b >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(MASK))


def splitmix32(x: Column) -> Column:
    """D-3: mixes a 32-bit number; consecutive ones seed other generators."""
    z = (x + 0x9E3779B9).bitwiseAND(F.lit(MASK))
    z = _times32(z.bitwiseXOR(F.shiftrightunsigned(z, 16)), 0x85EBCA6B)
    z = _times32(z.bitwiseXOR(F.shiftrightunsigned(z, 13)), 0xC2B2AE35)
    return z.bitwiseXOR(F.shiftrightunsigned(z, 16))


def _turn(x: Column, k: int) -> Column:
    return F.shiftleft(x, k).bitwiseAND(F.lit(MASK)).bitwiseOR(F.shiftrightunsigned(x, 32 - k))


def xoshiro128(seeds: Column, n: int) -> Column:
    """D-3: the first n numbers of xoshiro128** from a state of four 32-bit numbers, as an array."""
    start = F.struct(*[F.get(seeds, F.lit(k)).cast("long").alias(f"s{k}") for k in range(4)], F.array().cast("array<long>").alias("out"))

    def step(s, _):
        value = (_turn((s["s1"] * 5).bitwiseAND(F.lit(MASK)), 7) * 9).bitwiseAND(F.lit(MASK))
        a, b = s["s2"].bitwiseXOR(s["s0"]), s["s3"].bitwiseXOR(s["s1"])
        s1, s0 = s["s1"].bitwiseXOR(a), s["s0"].bitwiseXOR(b)
        s2 = a.bitwiseXOR(F.shiftleft(s["s1"], 9).bitwiseAND(F.lit(MASK)))
        return F.struct(s0.alias("s0"), s1.alias("s1"), s2.alias("s2"), _turn(b, 11).alias("s3"), F.concat(s["out"], F.array(value)).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, step, lambda s: s["out"])
