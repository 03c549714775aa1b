"""Sample ensembles to quantile forecasts, with national sums, checks and trims."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import normal
from ..functions.names import quantile_label
from ..functions.seasons import horizon_label, horizon_of
from ..schemas import QUANTILES

#: The eleven central pairs of levels.
PAIRS = tuple((QUANTILES[i], QUANTILES[-1 - i]) for i in range(11))


def ensemble_quantiles(samples: DataFrame, keys: list[str], levels: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Exact quantiles over samples, linear between neighbours: rows (keys, quantile, value); equal to ``percentile``.

    A cell's values are sorted (Spark spills what does not fit) and each row gives the levels that lie between
    it and the next one, so nothing of a cell's size is held in an aggregate.  Nulls do not count.
    """
    cell = Window.partitionBy(*keys)
    order = cell.orderBy("value")
    at, n = F.row_number().over(order) - 1, F.count("*").over(cell)
    rows = samples.where(F.col("value").isNotNull()).select(*keys, F.col("value").cast("double").alias("value"), at.alias("_i"), n.alias("_n"), F.lead(F.col("value").cast("double")).over(order).alias("_next"))
    mine = F.filter(F.lit(list(levels)), lambda q: F.floor(q * (F.col("_n") - 1)) == F.col("_i"))
    each = rows.select("*", F.explode(mine).alias("quantile"))
    past = F.col("quantile") * (F.col("_n") - 1) - F.col("_i")
    between = (1 - past) * F.col("value") + past * F.col("_next")
    return each.select(*keys, "quantile", F.when((past > 0) & (F.col("_next") != F.col("value")), between).otherwise(F.col("value")).alias("value"))


def national_samples(samples: DataFrame, keys: list[str], places: DataFrame | None = None) -> DataFrame:
    """Sum over places within each sample; only real places where these are given."""
    if places is not None:
        samples = samples.join(places.select("location"), "location", "left_semi")
    return samples.groupBy(*keys).agg(F.sum("value").alias("value"))


def national_quantiles(samples: DataFrame, keys: list[str], levels: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Quantiles of the national sums (not sums of quantiles)."""
    return ensemble_quantiles(national_samples(samples, [*keys, "sample_id"]), keys, levels).withColumn("location", F.lit("US"))


def mean_heatmap(samples: DataFrame, keys: list[str], stat: str = "mean", sample_id: int | None = None) -> DataFrame:
    if stat == "sample":
        return samples.where(F.col("sample_id") == sample_id).select(*keys, "value")
    value = F.avg("value") if stat == "mean" else F.percentile("value", F.lit(0.5))
    return samples.groupBy(*keys).agg(value.alias("value"))


def monotone_violations(forecasts: DataFrame, unit: list[str], quantile: str = "output_type_id") -> DataFrame:
    """Units where a value falls as the quantile rises; the first is compared with zero."""
    before = F.lag("value", 1, 0.0).over(Window.partitionBy(*unit).orderBy(quantile))
    return forecasts.withColumn("_fall", (F.col("value") < before).cast("int")).groupBy(*unit).agg(F.sum("_fall").alias("n_falls")).where("n_falls > 0")


def validate_forecast(forecasts: DataFrame, unit: list[str], quantile: str = "output_type_id") -> DataFrame:
    """One row: counts of negative and null values, and of falling quantiles."""
    before = F.lag("value", 1, 0.0).over(Window.partitionBy(*unit).orderBy(quantile))
    return forecasts.withColumn("_fall", F.col("value") < before).agg(F.count_if(F.col("value") < 0).alias("n_negative"), F.count_if(F.col("value").isNull()).alias("n_null"), F.count_if("_fall").alias("n_falls"))


def check_forecast(forecasts: DataFrame, unit: list[str]) -> DataFrame:
    bad = validate_forecast(forecasts, unit).head()
    if any(bad):
        raise ValueError(f"forecast is not valid: {bad.asDict()}")
    return forecasts


def export_hub_2023(quantiles: DataFrame, reference: str = "reference_date") -> DataFrame:
    """Rows (location, target_end_date, quantile, value) in the newer hub layout, horizons 0 to 3."""
    out = quantiles.withColumn("horizon", horizon_of(F.col(reference), F.col("target_end_date"))).where(F.col("horizon").between(0, 3))
    return out.select(F.col(reference).alias("reference_date"), F.lit("wk inc flu hosp").alias("target"), "horizon", "target_end_date", "location", F.lit("quantile").alias("output_type"), quantile_label(F.col("quantile")).alias("output_type_id"), "value")


def export_hub_2022(quantiles: DataFrame, forecast: str = "forecast_date") -> DataFrame:
    """The older layout, 1 to 4 weeks ahead."""
    out = quantiles.withColumn("_h", horizon_of(F.col(forecast), F.col("target_end_date"), first=1)).where(F.col("_h").between(1, 4))
    return out.select(F.col(forecast).alias("forecast_date"), "target_end_date", "location", F.lit("quantile").alias("type"), quantile_label(F.col("quantile"), trim=False).alias("quantile"), "value", horizon_label(F.col("_h")).alias("target"))


def pair_quantiles(forecasts: DataFrame, keys: list[str], quantile: str = "output_type_id") -> DataFrame:
    """Lower and upper value of each central pair, side by side, in one pass."""
    q = F.round(F.col(quantile), 6)
    pairs = F.array(*[F.struct(F.lit(lo).alias("lower_q"), F.max(F.when(q == lo, F.col("value"))).alias("lower"), F.max(F.when(q == hi, F.col("value"))).alias("upper")) for lo, hi in PAIRS])
    return forecasts.groupBy(*keys).agg(pairs.alias("_p")).select(*keys, F.explode("_p").alias("_p")).select(*keys, "_p.*")


def quantile_fans(forecasts: DataFrame, keys: list[str], date: str, reference: str) -> DataFrame:
    """Bands and median, with a flag for what lies after the reference date."""
    bands = pair_quantiles(forecasts, [*keys, date])
    median = forecasts.where(F.round("output_type_id", 6) == 0.5).select(*keys, date, F.col("value").alias("median"))
    return bands.join(median, [*keys, date]).withColumn("future", F.col(date) > F.lit(reference).cast("date"))


def prune_trends(national: DataFrame, keys: list[str], date: str, start: str, end: str, most: float = 2.0, least: float = 0.7) -> DataFrame:
    """Keys and samples whose national value at the end is within [least, most] times the start's."""
    at = lambda d: F.sum(F.when(F.col(date) == F.lit(d).cast("date"), F.col("value")))
    both = national.groupBy(*keys, "sample_id").agg(at(start).alias("a"), at(end).alias("b"))
    return both.where((F.col("b") <= most * F.col("a")) & (F.col("b") >= least * F.col("a"))).select(*keys, "sample_id")


def rescale_to_last_obs(samples: DataFrame, last: DataFrame, start: DataFrame, noise: float = 0.05, clip: float = 0.1, seed: str = "rescale") -> DataFrame:
    """Each place's samples times (last observed / forecast at the start) times clipped noise."""
    z = F.greatest(F.lit(1 - clip), F.least(F.lit(1 + clip), 1 + noise * normal(seed, "sample_id", "location")))
    j = samples.join(last.select("location", F.col("value").alias("_o")), "location").join(start.select("location", "sample_id", F.col("value").alias("_s")), ["location", "sample_id"])
    return j.withColumn("value", F.when(F.col("_s") > 0, F.col("value") * F.col("_o") / F.col("_s") * z).otherwise(F.col("value"))).drop("_o", "_s")


def mean_national_curve(samples: DataFrame, keys: list[str], chosen: list[int]) -> DataFrame:
    nat = national_samples(samples.where(F.col("sample_id").isin(*chosen)), [*keys, "sample_id"])
    return nat.groupBy(*keys).agg(F.avg("value").alias("value"))


def sample_value_range(samples: DataFrame, chosen: list[int]) -> DataFrame:
    return samples.where(F.col("sample_id").isin(*chosen)).agg(F.min("value").alias("least"), F.max("value").alias("most"))


def national_forecast_stats(samples: DataFrame, run: str = "run_id") -> DataFrame:
    nat = national_samples(samples, [run, "date", "sample_id"])
    return nat.groupBy(run).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("n"))
