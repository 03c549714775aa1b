"""Masks over weeks and places: 1 keeps a cell, 0 hides it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.seasons import season_week, week_saturday


def mask_grid(axis: DataFrame, weeks: int = 53) -> DataFrame:
    """All cells of (location_code, place) and week with keep = 1."""
    return axis.select("location_code", "place", F.explode(F.sequence(F.lit(1), F.lit(weeks))).alias("season_week")).withColumn("keep", F.lit(1))


def in_dates(ranges: list[tuple[str, str] | str]) -> Column:
    """Weeks from the first to the last week of any range, or the week of a single date."""
    hit = F.lit(False)
    for r in ranges:
        a, b = (r, r) if isinstance(r, str) else r
        lo, hi = (season_week(F.lit(x).cast("date")) for x in (a, b))
        hit = hit | F.col("season_week").between(lo, hi)
    return hit


def _zero(grid: DataFrame, hit: Column) -> DataFrame:
    return grid.withColumn("keep", F.when(hit, 0).otherwise(F.col("keep")))


def mask_dates(grid: DataFrame, ranges: list) -> DataFrame:
    return _zero(grid, in_dates(ranges))


def mask_locations(grid: DataFrame, codes: list[str]) -> DataFrame:
    """Unknown codes are an error."""
    have = {r[0] for r in grid.where(F.col("location_code").isin(*codes)).select("location_code").distinct().collect()}
    if set(codes) - have:
        raise ValueError(f"unknown locations: {sorted(set(codes) - have)}")
    return _zero(grid, F.col("location_code").isin(*codes))


def mask_dates_for_locations(grid: DataFrame, ranges: list, codes: list[str]) -> DataFrame:
    return _zero(grid, in_dates(ranges) & F.col("location_code").isin(*codes))


def mask_checkerboard(grid: DataFrame, weeks: int, places: int) -> DataFrame:
    on = (F.floor((F.col("season_week") - 1) / max(1, weeks)) + F.floor(F.col("place") / max(1, places))) % 2 == 0
    return _zero(grid, on)


#: The places of the named masks.
FIVE, FIVE2 = ["06", "37", "15", "42", "53"], ["13", "49", "18", "36", "24"]


def named_masks(grid: DataFrame, season: int) -> DataFrame:
    """The named masks of the experiments as one table (mask, season_week, location_code, keep).

    Only places of the grid are hidden; the first half of the axis is by place order.
    """
    y, z = season, season + 1
    mid, peak, gap, past = (f"{y}-12-07", f"{z}-01-07"), (f"{z}-02-01", f"{z}-02-15"), (f"{z}-12-07", f"{z}-02-15"), (f"{z}-08-01", f"{z}-01-07")
    # fixed values: the masks' names, dates and block sizes
    # one row beside the grid, so that nothing runs while the plan is made
    grid = grid.join(F.broadcast(grid.agg(F.countDistinct("place").alias("_places"))))
    half = F.col("place") < F.floor(F.col("_places") / 2)
    at = lambda codes: F.col("location_code").isin(*codes)
    last = season_week(week_saturday(F.lit(y), F.lit(52)))
    rules: dict[str, Column] = {
        "missing_midseason": in_dates([mid]),
        "missing_midseason_peak": in_dates([peak]),
        "missing_midseason_biggap": in_dates([gap]),
        "missing_past": in_dates([past]),
        "missing_half_subpop": half,
        "missing_nc": at(["37"]),
        "missing_ca": at(["06"]),
        "missing_il": at(["17"]),
        "missing_five": at(FIVE),
        "missing_five2": at(FIVE2),
        "missing_midseason_biggap_halfpop": in_dates([gap]) | half,
        "missing_midseason_doublegap": in_dates([mid, peak]),
        "missing_five_after_dec07": at(FIVE) & F.col("season_week").between(season_week(F.lit(f"{y}-12-07").cast("date")), last),
        "missing_checkerboard_4x4": (F.floor((F.col("season_week") - 1) / 4) + F.floor(F.col("place") / 4)) % 2 == 0,
        "missing_checkerboard_2x2": (F.floor((F.col("season_week") - 1) / 2) + F.floor(F.col("place") / 2)) % 2 == 0,
        "missing_first_half_selected": at(FIVE) & (F.col("season_week") <= 26),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), F.when(c, 0).otherwise(1).alias("keep")) for k, c in rules.items()]))
    return grid.select("season_week", "location_code", each.alias("m")).select("m.mask", "season_week", "location_code", "m.keep")


def masked_quantiles(samples: DataFrame, mask: DataFrame, keys: list[str], most_places: int = 5) -> DataFrame:
    """Quantiles of hidden cells only, for the first few places that have any."""
    from .forecasts import ensemble_quantiles

    hidden = mask.where("keep = 0").select("location_code", "season_week").distinct()
    few = hidden.select("location_code").distinct().orderBy("location_code").limit(most_places)
    cells = samples.join(hidden.join(few, "location_code", "left_semi"), ["location_code", "season_week"], "left_semi")
    return ensemble_quantiles(cells, keys)
