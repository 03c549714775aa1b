"""Value transforms and augmentation: per cell as column expressions, per frame by hashed draws."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import fine_uniform, hashed, integer_between, normal, skew_normal, uniform_between


def scale(x: Column, s) -> Column:
    return x * s


def unscale(x: Column, s) -> Column:
    return x / s


def square(x: Column) -> Column:
    return x * x


def shift(x: Column, s=-1.0) -> Column:
    return x + s


def unshift(x: Column, s=-1.0) -> Column:
    return x - s


def roll_in_time(rows: DataFrame, by: Column | int, size: int = 64, week: str = "week_idx") -> DataFrame:
    """Cyclic shift along the padded week axis."""
    return rows.withColumn(week, F.pmod(F.col(week) + by, F.lit(size)).cast("int"))


def random_roll(rows: DataFrame, low: int, high: int, seed: object) -> DataFrame:
    """One shift in [low, high) per frame."""
    return roll_in_time(rows, integer_between(low, high, seed, "frame_id"))


def random_pad(rows: DataFrame, low: int, high: int, seed: object, neutral: float = 0.0, size: int = 64) -> DataFrame:
    """Roll by one shift per frame; the weeks that came round the end are neutral."""
    s = integer_between(low, high, seed, "frame_id")
    rolled = roll_in_time(rows.withColumn("_s", s), F.col("_s"), size)
    round_the_end = ((F.col("_s") > 0) & (F.col("week_idx") < F.col("_s"))) | ((F.col("_s") < 0) & (F.col("week_idx") >= size + F.col("_s")))
    return rolled.withColumn("value", F.when(round_the_end, F.lit(neutral)).otherwise(F.col("value"))).drop("_s")


def random_scale(rows: DataFrame, low: float, high: float, seed: object) -> DataFrame:
    """One uniform factor per frame."""
    return rows.withColumn("value", F.col("value") * uniform_between(low, high, seed, "frame_id"))


def random_noise(rows: DataFrame, sigma: float, seed: object, keys: tuple[str, ...] = ("frame_id", "week_idx", "location_code")) -> DataFrame:
    return rows.withColumn("value", F.col("value") * (1 + sigma * normal(seed, *keys)))


def skewed_noise(rows: DataFrame, alpha: float, location: float, spread: float, seed: object, keys: tuple[str, ...] = ("frame_id", "week_idx", "location_code")) -> DataFrame:
    return rows.withColumn("value", F.greatest(F.lit(0.0), F.col("value") * skew_normal(alpha, location, spread, seed, *keys)))


#: Means up to which Poisson draws invert the distribution; above it they are drawn by rejection.  Both are exact.
INVERTED_MEAN, TRIES = 30, 100
_SMALL_LOGS = [math.lgamma(k + 1) for k in range(10)]


def log_factorial(k: Column) -> Column:
    """ln k!, by Stirling's series from 10 on (relative error below 1e-14)."""
    x = F.greatest(k, F.lit(10.0))
    series = 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5))) - 1 / (1680 * F.pow(x, F.lit(7)))
    return F.when(k < 10, F.get(F.lit(_SMALL_LOGS), k.cast("int"))).otherwise((x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + series)


def _rejected(mean: Column, seed: object, keys: tuple[str, ...]) -> Column:
    """Poisson draw by transformed rejection with a squeeze (published by Hoermann, 1993): the first attempt that holds.

    Attempt i takes two uniforms of the hash of (seed, keys, i).  Some nine of ten hold; should none of ``TRIES`` do
    (a chance below 1e-50), the row raises instead of returning another law.
    """
    m = F.greatest(mean, F.lit(float(INVERTED_MEAN)))
    # fixed values: the method's constants
    b = 0.931 + 2.53 * F.sqrt(m)
    a = -0.059 + 0.02483 * b
    inverse_alpha, squeeze = 1.1239 + 1.1328 / (b - 3.4), 0.9277 - 3.6224 / (b - 2)

    def attempt(i: Column) -> Column:
        u, v = fine_uniform(seed, *keys, i, part=0) - 0.5, fine_uniform(seed, *keys, i, part=1)
        us = 0.5 - F.abs(u)
        k = F.floor((2 * a / us + b) * u + m + 0.43).cast("double")
        inside = (F.log(v) + F.log(inverse_alpha) - F.log(a / (us * us) + b)) <= (-m + k * F.log(m) - log_factorial(F.greatest(k, F.lit(0.0))))
        holds = ((us >= 0.07) & (v <= squeeze)) | ((k >= 0) & ~((us < 0.013) & (v > us)) & inside)
        return F.when(holds, k)

    later = F.aggregate(F.sequence(F.lit(1), F.lit(TRIES - 1)), F.lit(None).cast("double"), lambda acc, i: F.when(acc.isNotNull(), acc).otherwise(attempt(i)))
    return F.coalesce(attempt(F.lit(0)), later, F.raise_error(F.lit("no attempt of a Poisson draw held")).cast("double"))


def _inverted(mean: Column, u: Column) -> Column:
    """How many terms of the distribution function are at most u."""
    zero = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), (F.exp(-mean) <= u).cast("int").alias("k"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        c = acc["c"] + p
        # a term that no longer changes the sum ends the search
        grown = F.struct(p.alias("p"), c.alias("c"), (acc["k"] + ((c <= u) & (c > acc["c"])).cast("int")).alias("k"))
        return F.when(acc["c"] > u, acc).otherwise(grown)

    # beyond these terms nothing is left in 53 bits
    most = F.least(F.lit(4 * INVERTED_MEAN), F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int"))
    return F.aggregate(F.sequence(F.lit(1), most), zero, step, lambda acc: acc["k"].cast("double"))


def poisson(rows: DataFrame, seed: object = 0, keys: tuple[str, ...] = ("frame_id", "week_idx", "location_code")) -> DataFrame:
    """Poisson draws with mean ``value``, exact for every mean: by inversion of a hashed uniform up to ``INVERTED_MEAN``,
    by rejection over a stream of hashes above it.  Null and negative means count as 0."""
    mean = F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(0.0))
    low = F.least(mean, F.lit(float(INVERTED_MEAN)))
    return rows.withColumn("value", F.when(mean <= INVERTED_MEAN, _inverted(low, fine_uniform(seed, *keys))).otherwise(_rejected(mean, seed, keys)))


def enrich(rows: DataFrame, recipe: str, seed: int = 0) -> DataFrame:
    """The named augmentation recipes: No, Pois, PoisPadScale, PoisPadScaleSmall."""
    if recipe == "No":
        return rows
    out = poisson(rows, seed)
    if recipe == "Pois":
        return out
    # fixed values: the recipes' ranges
    low, high, least, most = {"PoisPadScale": (-15, 15, 0.1, 1.9), "PoisPadScaleSmall": (-4, 4, 0.7, 1.3)}[recipe]
    return random_scale(random_pad(out, low, high, f"{seed}pad"), least, most, f"{seed}scale")


def forward(name: str, x: Column, most: Column, mean: Column, std: Column) -> Column:
    """The named transforms Lins, Sqrt, LogZs and LinsZs."""
    return {"Lins": 2 * x / most, "Sqrt": 2 * F.sqrt(x / most), "LogZs": (F.log1p(x) - F.log(mean)) / F.log(std), "LinsZs": (x - mean) / std}[name]


def inverse(name: str, y: Column, most: Column, mean: Column, std: Column) -> Column:
    return {"Lins": y * most / 2, "Sqrt": (y / 2) * (y / 2) * most, "LogZs": F.expm1(y * F.log(std) + F.log(mean)), "LinsZs": y * std + mean}[name]


def roundtrip(rows: DataFrame, stats: DataFrame, names: tuple[str, ...] = ("Lins", "Sqrt", "LogZs", "LinsZs")) -> DataFrame:
    """Each cell's value after each transform and back; ``stats`` is one row."""
    j = rows.join(F.broadcast(stats))
    s = [F.col("most"), F.col("mean"), F.col("std")]
    return j.select(*rows.columns, *[inverse(n, forward(n, F.col("value"), *s), *s).alias(n) for n in names])


def repeat_dataset(frames: DataFrame, times: int, seed: object = 0) -> DataFrame:
    """Frame ids repeated and shuffled by hash; ``position`` orders them."""
    out = frames.select("frame_id", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("repeat"))
    return out.withColumn("position", hashed(seed, "frame_id", "repeat"))
