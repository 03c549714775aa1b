"""Scores of quantile forecasts: one grouped pass of conditional sums, no pairing and no user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = ("model", "group", "season", "reference_date", "target_end_date", "location", "horizon")


def _at(q: Column, level: float) -> Column:
    return F.round(q, 6) == F.lit(round(level, 6))


def _sum(c: Column) -> Column:
    return F.sum(c)


def wis_parts() -> dict[str, Column]:
    """Weighted interval score and its three parts, from rows (quantile, predicted, observed)."""
    q, x, y = F.col("quantile"), F.col("predicted"), F.col("observed")
    low, high, mid = F.round(q, 6) < 0.5, F.round(q, 6) > 0.5, _at(q, 0.5)
    half = F.count("*") / 2
    zero = F.lit(0.0)
    return {
        "wis": F.avg(2 * (F.when(y < x, 1.0).otherwise(0.0) - q) * (x - y)),
        "dispersion": _sum(F.when(low, -q * x).when(high, (1 - q) * x).otherwise(zero)) / half,
        "overprediction": _sum(F.when(low, F.greatest(x - y, zero)).when(mid, 0.5 * F.greatest(x - y, zero)).otherwise(zero)) / half,
        "underprediction": _sum(F.when(high, F.greatest(y - x, zero)).when(mid, 0.5 * F.greatest(y - x, zero)).otherwise(zero)) / half,
    }


def coverage(low: float, high: float) -> Column:
    """1 if the observed value lies in the closed interval, else 0."""
    q, x, y = F.col("quantile"), F.col("predicted"), F.col("observed")
    lo, hi = F.max(F.when(_at(q, low), x)), F.max(F.when(_at(q, high), x))
    return ((lo <= F.max(y)) & (F.max(y) <= hi)).cast("double")


def ae_median() -> Column:
    return F.max(F.when(_at(F.col("quantile"), 0.5), F.abs(F.col("observed") - F.col("predicted"))))


def quantile_bias() -> Column:
    q, x, y = F.col("quantile"), F.col("predicted"), F.col("observed")
    m, obs = F.max(F.when(_at(q, 0.5), x)), F.max(y)
    below = F.coalesce(1 - 2 * F.max(F.when(x <= y, q)), F.lit(1.0))
    above = F.coalesce(1 - 2 * F.min(F.when(x >= y, q)), F.lit(-1.0))
    return F.when(obs == m, 0.0).when(obs < m, below).otherwise(above)


def score(joined: DataFrame, unit: tuple[str, ...] = UNIT) -> DataFrame:
    """All metrics per forecast unit."""
    extra = {"interval_coverage_50": coverage(0.25, 0.75), "interval_coverage_90": coverage(0.05, 0.95), "ae_median": ae_median(), "bias": quantile_bias()}
    return joined.groupBy(*unit).agg(*[c.alias(k) for k, c in (wis_parts() | extra).items()])


def wis_interval_normalized(joined: DataFrame, unit: tuple[str, ...] = UNIT, levels: tuple[float, ...] = (0.01, 0.025, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45)) -> DataFrame:
    """The older form: weighted intervals divided by their weights, no median term."""
    if list(levels) != sorted(levels):
        raise ValueError("levels must be sorted")
    q, x, y, zero = F.round(F.col("quantile"), 6), F.col("predicted"), F.col("observed"), F.lit(0.0)
    lows = [round(v, 6) for v in levels]
    highs = [round(1 - v, 6) for v in levels]
    weight = float(sum(levels))
    is_low, is_high = q.isin(*lows), q.isin(*highs)
    sharp = _sum(F.when(is_low, -q * x).when(is_high, (1 - q) * x).otherwise(zero)) / weight
    lower = _sum(F.when(is_low, F.greatest(x - y, zero)).otherwise(zero)) / weight
    upper = _sum(F.when(is_high, F.greatest(y - x, zero)).otherwise(zero)) / weight
    return joined.groupBy(*unit).agg((sharp + lower + upper).alias("total"), sharp.alias("sharpness"), (lower + upper).alias("calibration"), lower.alias("calibration_lower"), upper.alias("calibration_upper"))


def relative_score(scores: DataFrame, baseline: str, keys: tuple[str, ...] = ("location", "target_end_date", "horizon"), metric: str = "wis") -> DataFrame:
    """Add the ratio to the baseline model's score; null where that is missing or not positive."""
    base = scores.where(F.col("model") == baseline).groupBy(*keys).agg(F.min(metric).alias("_base"))
    return scores.join(base, list(keys), "left").withColumn(f"relative_{metric}", F.when(F.col("_base") > 0, F.col(metric) / F.col("_base"))).drop("_base")


def component_share(scores: DataFrame, keys: tuple[str, ...] = ("target_end_date", "horizon")) -> DataFrame:
    """Sharpness and overprediction as shares of the total, by key."""
    total = F.sum(F.col("dispersion") + F.col("overprediction") + F.col("underprediction"))
    return scores.groupBy(*keys).agg((F.sum("dispersion") / total).alias("sharpness_share"), (F.sum("overprediction") / total).alias("over_share"))
