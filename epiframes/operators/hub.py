"""Forecast hub tables: normalising, filtering, completeness and the join with truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bitmaps import bitmaps, counted, with_positions
from ..schemas import QUANTILES


def normalize_hub_columns(df: DataFrame, target: str = "wk inc flu hosp") -> DataFrame:
    """Both hub layouts under the newer names; a missing target gets the default."""
    names = {"type": "output_type", "quantile": "output_type_id", "forecast_date": "reference_date"}
    out = df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns and b not in df.columns})
    have = F.col("target") if "target" in out.columns else F.lit(None).cast("string")
    return out.withColumn("target", F.coalesce(have, F.lit(target)))


def union_hubs(*tables: DataFrame) -> DataFrame:
    out = normalize_hub_columns(tables[0])
    for t in tables[1:]:
        out = out.unionByName(normalize_hub_columns(t), allowMissingColumns=True)
    return out


def filter_quantile_rows(df: DataFrame, target: str = "wk inc flu hosp", horizons: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
    """Quantile rows of one target and the horizons; text that is no number becomes null."""
    kept = df.where((F.col("output_type") == "quantile") & (F.col("target") == target) & F.col("horizon").try_cast("int").isin(*horizons))
    return kept.withColumns({"output_type_id": F.col("output_type_id").try_cast("double"), "value": F.col("value").try_cast("double"), "horizon": F.col("horizon").try_cast("int")})


def required(q=None):
    levels = [round(x, 6) for x in QUANTILES]
    return F.round(F.col("output_type_id").cast("double") if q is None else q, 6).isin(*levels)


def quantile_completeness(df: DataFrame, keys: tuple[str, ...] = ("model", "reference_date")) -> DataFrame:
    """Keep only keys with all 23 levels: one bit a level, joined by "or"."""
    place = F.array_position(F.lit([round(x, 6) for x in QUANTILES]), F.round(F.col("output_type_id").cast("double"), 6))
    have = df.where(required()).groupBy(*keys).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (place - 1).cast("int"))).alias("levels"))
    return df.join(have.where(F.bit_count("levels") == len(QUANTILES)).select(*keys), list(keys), "left_semi")


def score_input(forecasts: DataFrame, truth: DataFrame, on_season: bool = False) -> DataFrame:
    """Forecast rows with the observed value (columns predicted, observed, quantile)."""
    f = forecasts.withColumnsRenamed({"value": "predicted", "output_type_id": "quantile"})
    t = truth.select(F.col("date").alias("target_end_date"), "location", F.col("value").alias("observed"), *(["season"] if on_season else []))
    return f.join(t, ["target_end_date", "location", *(["season"] if on_season else [])])


def lost_rows(forecasts: DataFrame, truth: DataFrame) -> DataFrame:
    """The guard of the join: forecast rows without truth, by model."""
    t = truth.select(F.col("date").alias("target_end_date"), "location")
    return forecasts.join(t, ["target_end_date", "location"], "left_anti").groupBy("model").agg(F.count("*").alias("n_lost"))


def check_score_input(forecasts: DataFrame, truth: DataFrame) -> DataFrame:
    """The joined rows, or ValueError if their number differs from the forecasts'."""
    out = score_input(forecasts, truth)
    before, after = forecasts.count(), out.count()
    if before != after:
        raise ValueError(f"the join with truth gives {after} rows for {before} forecast rows")
    return out


def drop_null_truth(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["observed"])


def overlap_report(a: DataFrame, b: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """For each column: values in the first only, in both, in the second only; all columns in one pass over both tables."""
    texts = [F.col(c).cast("string").alias(c) for c in columns]
    both = a.select(*texts, F.lit("l").alias("_side")).unionByName(b.select(*texts, F.lit("r").alias("_side")))
    maps = bitmaps(with_positions(both, list(columns)), ["_side"], list(columns))
    sides = counted(maps, ["_side"], list(columns)).agg(*[F.coalesce(F.sum(F.when(F.col("_side") == s, F.col(f"n_{c}"))), F.lit(0)).alias(f"{s}_{c}") for s in "lr" for c in columns])
    whole = counted(maps, [], list(columns))
    either, left, right = (lambda c: F.coalesce(f"n_{c}", F.lit(0))), (lambda c: F.col(f"l_{c}")), (lambda c: F.col(f"r_{c}"))
    lines = [F.struct(F.lit(c).alias("dimension"), (either(c) - right(c)).alias("left_only"), (left(c) + right(c) - either(c)).alias("both"), (either(c) - left(c)).alias("right_only")) for c in columns]
    return sides.crossJoin(whole).select(F.inline(F.array(*lines)))  # one row each


def missing_set(required_rows: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    return required_rows.select(*keys).distinct().join(have.select(*keys), keys, "left_anti")


def common_set(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))
