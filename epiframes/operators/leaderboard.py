"""Rankings, inclusion, completeness, components and pivots over the score table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bitmaps import bitmaps, counted, distinct_counts, with_positions

PARTS = ("dispersion", "overprediction", "underprediction")


def _stat(metric: str, how: str) -> Column:
    return {"sum": F.sum(metric), "mean": F.avg(metric), "median": F.percentile(metric, F.lit(0.5))}[how]


def filter_to(scores: DataFrame, chosen: DataFrame, keys: list[str] = ("model",)) -> DataFrame:
    return scores.join(chosen.select(*keys), list(keys), "left_semi")


def rankings(scores: DataFrame, metric: str = "wis", how: str = "sum") -> DataFrame:
    return scores.groupBy("model").agg(_stat(metric, how).alias("score"))


def component_summary(scores: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in PARTS]
    means = [F.avg(c).alias(c) for c in ("interval_coverage_50", "interval_coverage_90")]
    return scores.groupBy("model", "group").agg(*sums, *means, F.sum(sum((F.col(c) for c in PARTS[1:]), F.col(PARTS[0]))).alias("total"))


def sum_over_locations(scores: DataFrame, valid: DataFrame) -> DataFrame:
    return scores.join(valid.select("location"), "location", "left_semi").groupBy("model", "group", "season", "target_end_date", "horizon").agg(F.sum("wis").alias("wis"))


def components_by_location(scores: DataFrame, name: str = "States_Sum") -> DataFrame:
    """Long form of the parts by location, with a row for all locations: one grouping-set pass."""
    both = scores.select("model", "group", F.explode(F.array(F.col("location"), F.lit(name))).alias("location"), *PARTS)
    wide = both.groupBy("model", "group", "location").agg(*[F.sum(c).alias(c) for c in PARTS])
    return wide.unpivot(["model", "group", "location"], list(PARTS), "component", "value")


def missing_report(scores: DataFrame, models: DataFrame, locations: int, horizons: int, dates: int, critical: float = 0.9) -> DataFrame:
    """Expected, actual and missing cells per model; a model without rows is fully missing."""
    have = distinct_counts(scores, ["model"], ["location", "horizon", "target_end_date"], actual=(F.count("*"), F.sum("_o_actual")))
    have = have.withColumnsRenamed({"n_location": "l", "n_horizon": "h", "n_target_end_date": "d"})
    out = models.select("model").distinct().join(have, "model", "left")
    expected = F.lit(locations * horizons * dates)
    actual = F.coalesce("actual", F.lit(0))
    missing = F.greatest(F.lit(0), expected - actual)
    gap = lambda n, c: F.greatest(F.lit(0), F.lit(n) - F.coalesce(c, F.lit(0)))
    return out.select("model", expected.alias("expected"), actual.alias("actual"), missing.alias("missing"), gap(locations, "l").alias("missing_locations"), gap(horizons, "h").alias("missing_horizons"), gap(dates, "d").alias("missing_dates"), (100 * (1 - missing / expected)).alias("completion"), ((missing > 0) & (actual < critical * expected)).alias("critical"))


def model_inclusion(scores: DataFrame, date: str = "target_end_date", allow: int = 5) -> DataFrame:
    """(model, season, include, include_combined): within ``allow`` dates of the season's count; combined
    needs every season, and absence from one counts as failing it."""
    # the bitmap of a season's dates is that of its models' joined, so the scores are gone over once
    maps = bitmaps(with_positions(scores, [date]), ["model", "season"], [date])
    seasons = counted(maps, ["season"], [date]).withColumnRenamed(f"n_{date}", "most")
    have = counted(maps, ["model", "season"], [date]).withColumnRenamed(f"n_{date}", "n")
    # models by seasons: both are dimensions
    grid = have.select("model").distinct().crossJoin(seasons)
    flags = grid.join(have, ["model", "season"], "left").withColumn("include", F.coalesce(F.col("n") >= F.col("most") - allow, F.lit(False)))
    every = flags.groupBy("model").agg(F.bool_and("include").alias("include_combined"))
    return flags.select("model", "season", "include").join(every, "model")


def leaderboard(scores: DataFrame) -> DataFrame:
    """wis sums and relative means for each season and Combined, over included models, ranked; one pass over the scores."""
    flags = model_inclusion(scores)
    joined = scores.join(flags, ["model", "season"])
    labels = F.array_compact(F.array(F.when(F.col("include"), F.col("season")), F.when(F.col("include_combined"), F.lit("Combined"))))
    agg = joined.select("model", F.explode(labels).alias("season"), "wis", "relative_wis").groupBy("season", "model").agg(F.sum("wis").alias("wis"), F.avg("relative_wis").alias("relative_wis"))
    long = agg.unpivot(["season", "model"], ["wis", "relative_wis"], "metric", "score").where("score is not null")
    return leaderboard_rank(long.withColumn("aggregation", F.when(F.col("metric") == "wis", "sum").otherwise("mean")))


def leaderboard_rank(board: DataFrame) -> DataFrame:
    return board.withColumn("rank", F.row_number().over(Window.partitionBy("season", "metric").orderBy("score", "model")))


def leaderboard_pivot(board: DataFrame) -> DataFrame:
    return board.groupBy("season", "model").pivot("metric", ["wis", "relative_wis"]).agg(F.first("score"))


def cumulative_score(scores: DataFrame) -> DataFrame:
    daily = scores.groupBy("model", "group", "target_end_date").agg(F.sum("wis").alias("wis"))
    w = Window.partitionBy("model", "group").orderBy("target_end_date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("cumulative_wis", F.sum("wis").over(w))


def average_rank(board: DataFrame) -> DataFrame:
    """Ranks with ties averaged, per season and metric, and their sum."""
    def rank(c: str) -> Column:
        return F.rank().over(Window.partitionBy("season").orderBy(c)) + (F.count("*").over(Window.partitionBy("season", c)) - 1) / 2

    out = board.withColumns({"rk_wis": rank("wis"), "rk_relative_wis": rank("relative_wis")})
    return out.withColumn("sum_rank", F.col("rk_wis") + F.col("rk_relative_wis"))


def season_rank_wide(ranked: DataFrame, seasons: list[str]) -> DataFrame:
    """One row per model: sum_rank by season, and the total with absences as 0."""
    wide = ranked.groupBy("model").pivot("season", seasons).agg(F.first("sum_rank"))
    total = sum((F.coalesce(F.col(f"`{s}`"), F.lit(0.0)) for s in seasons), F.lit(0.0))
    return wide.withColumn("total_rank", total)


def top_n_per_group(scores: DataFrame, n: int, metric: str = "wis", group: str = "group") -> DataFrame:
    """Models with the n lowest means per group; for relative metrics the n closest to one."""
    means = scores.groupBy(group, "model").agg(F.avg(metric).alias("value"))
    by = F.abs(F.col("value") - 1) if metric.startswith("relative") else F.col("value")
    return means.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(by, "model"))).where(F.col("rank") <= n)


def top_n_per_facet(scores: DataFrame, n: int, facet: str, metric: str = "wis") -> DataFrame:
    return top_n_per_group(scores, n, metric, facet).select("model").distinct()


def top5_any_season(scores: DataFrame, n: int = 5) -> DataFrame:
    a, b = top_n_per_group(scores, n, "wis", "season"), top_n_per_group(scores, n, "relative_wis", "season")
    return a.select("model").union(b.select("model")).distinct()


def score_heatmap(scores: DataFrame, how: str = "mean") -> DataFrame:
    """Model by (date, horizon) means in long form, with the order of the models."""
    cells = scores.groupBy("model", "target_end_date", "horizon").agg(F.avg("wis").alias("wis"))
    order = cells.groupBy("model").agg(_stat("wis", how).alias("row_score")).withColumn("row_order", F.row_number().over(Window.orderBy("row_score", "model")))
    return cells.join(F.broadcast(order), "model")


def wide_leaderboard(scores: DataFrame) -> DataFrame:
    return scores.groupBy("season", "model").agg(F.sum("wis").alias("wis"), F.avg("relative_wis").alias("relative_wis"))


def score_components_wide(scores: DataFrame) -> DataFrame:
    long = scores.unpivot(["model"], list(PARTS), "wis_type", "value")
    return long.groupBy("model").pivot("wis_type", list(PARTS)).agg(F.sum("value"))


def exclude_outliers(board: DataFrame, most: float = 1.5) -> DataFrame:
    return board.where(F.col("relative_wis") <= most)


def exclude_models(df: DataFrame, prefixes: tuple[str, ...] = (), names: tuple[str, ...] = (), parts: tuple[str, ...] = (), column: str = "model") -> DataFrame:
    c = F.col(column)
    for p in prefixes:
        df = df.where(~F.startswith(c, F.lit(p)))
    for p in parts:
        df = df.where(~F.contains(c, F.lit(p)))
    return df.where(~c.isin(*names)) if names else df
