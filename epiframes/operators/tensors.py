"""Frames as padded grids, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 64


def frames_to_tensor(rows: DataFrame, axis: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per frame: ``tensor``, weeks by places in axis order, padded with zeros to size x size.

    ``axis`` has (location_code, place), place from 0.
    """
    placed = rows.join(F.broadcast(axis.select("location_code", "place")), "location_code")
    span = F.sequence(F.lit(0), F.lit(size - 1))
    # a week's places first, then a frame's weeks: look-ups scan one week or one frame's weeks, never all cells
    cell = F.struct(F.col("place").cast("int").alias("place"), F.coalesce("value", F.lit(0.0)).alias("v"))
    weeks = placed.repartition("frame_id").groupBy("frame_id", "season_week").agg(F.map_from_entries(F.collect_list(cell)).alias("m"))
    rows = weeks.select("frame_id", (F.col("season_week") - 1).cast("int").alias("w"), F.transform(span, lambda p: F.coalesce(F.element_at("m", p), F.lit(0.0))).alias("row"))
    maps = rows.groupBy("frame_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "row"))).alias("m"))
    empty = F.array_repeat(F.lit(0.0), size)
    return maps.select("frame_id", F.transform(span, lambda w: F.coalesce(F.element_at("m", w), empty)).alias("tensor"))


def tensor_to_long(tensors: DataFrame, axis: DataFrame, weeks: int = 53) -> DataFrame:
    """Cells of real weeks and places only."""
    rows = tensors.select("frame_id", F.posexplode("tensor").alias("w", "row")).where(F.col("w") < weeks)
    cells = rows.select("frame_id", (F.col("w") + 1).alias("season_week"), F.posexplode("row").alias("place", "value"))
    return cells.join(F.broadcast(axis.select("location_code", "place")), "place").select("frame_id", "season_week", "location_code", "value")


def value_stats(tensors: DataFrame, real_cells: tuple[int, int] | None = None) -> DataFrame:
    """Max, mean and population deviation over all padded cells, or only over real ones (weeks, places)."""
    cells = tensors.select(F.posexplode("tensor").alias("w", "row")).select("w", F.posexplode("row").alias("p", "value"))
    if real_cells:
        cells = cells.where((F.col("w") < real_cells[0]) & (F.col("p") < real_cells[1]))
    return cells.agg(F.max("value").alias("most"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def place_columns(rows: DataFrame, date: str, places: list[str]) -> DataFrame:
    """Date by place matrix in axis order."""
    return rows.groupBy(date).pivot("location_code", places).agg(F.sum("value"))
