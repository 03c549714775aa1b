"""Deterministic draws: md5 of a seed and keys, the same for any partitioning and on every run."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed(seed: object, *keys: Column | str) -> Column:
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def uniform(seed: object, *keys: Column | str) -> Column:
    """In [0, 1)."""
    return F.conv(F.substring(hashed(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def fine_uniform(seed: object, *keys: Column | str, part: int = 0) -> Column:
    """In (0, 1) with 52 bits, both ends left out; ``part`` 0 and 1 are two independent draws of one hash."""
    bits = F.conv(F.substring(hashed(seed, *keys), 1 + 13 * part, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(4503599627370496.0)


def uniform_between(low: float, high: float, seed: object, *keys: Column | str) -> Column:
    return F.lit(float(low)) + uniform(seed, *keys) * F.lit(float(high - low))


def integer_between(low: int, high: int, seed: object, *keys: Column | str) -> Column:
    """In [low, high)."""
    return (F.lit(low) + F.floor(uniform(seed, *keys) * (high - low))).cast("int")


def normal(seed: object, *keys: Column | str) -> Column:
    """Standard normal by Box and Muller."""
    u = F.greatest(uniform(f"{seed}a", *keys), F.lit(1e-12))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * uniform(f"{seed}b", *keys))


def skew_normal(alpha: float, location: float, scale: float, seed: object, *keys: Column | str) -> Column:
    delta = alpha / math.sqrt(1 + alpha * alpha)
    z = delta * F.abs(normal(f"{seed}x", *keys)) + math.sqrt(1 - delta * delta) * normal(f"{seed}y", *keys)
    return F.lit(float(location)) + F.lit(float(scale)) * z
