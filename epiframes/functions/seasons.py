"""Season and date functions as pure column expressions; seasons start on a month and day (default August 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START = (8, 1)


def season_year(d: Column, start: tuple[int, int] = START) -> Column:
    """The season's first year."""
    early = (F.month(d) < start[0]) | ((F.month(d) == start[0]) & (F.dayofmonth(d) < start[1]))
    return (F.year(d) - early.cast("int")).cast("int")


def season_start(year: Column, start: tuple[int, int] = START) -> Column:
    return F.make_date(year, F.lit(start[0]), F.lit(start[1]))


def season_days(d: Column, start: tuple[int, int] = START) -> Column:
    return F.datediff(d, season_start(season_year(d, start), start))


def season_week(d: Column, start: tuple[int, int] = START) -> Column:
    """Weeks since the season's start, from 1."""
    return F.when(d.isNotNull(), F.greatest(F.lit(1), (F.floor(season_days(d, start) / 7) + 1).cast("int")))


def season_fraction(d: Column, start: tuple[int, int] = START) -> Column:
    return season_days(d, start) / F.lit(365.0)


def add_season_columns(df: DataFrame, date: str, epiweek: bool = False) -> DataFrame:
    d = F.col(date)
    cols = {"fluseason": season_year(d), "season_week": season_week(d), "fluseason_fraction": season_fraction(d)}
    return df.withColumns(cols | ({"epiweek": date_to_epiweek(d)} if epiweek else {}))


def week_start(year: Column, week: Column, start: tuple[int, int] = START) -> Column:
    return F.date_add(season_start(year, start), (week - 1) * 7)


def week_end(year: Column, week: Column, start: tuple[int, int] = START) -> Column:
    return F.date_add(week_start(year, week, start), 6)


def week_saturday(year: Column, week: Column, start: tuple[int, int] = START) -> Column:
    return F.next_day(F.date_sub(week_start(year, week, start), 1), "SAT")


def season_calendar(seasons: DataFrame, year: str = "season", start: tuple[int, int] = START) -> DataFrame:
    """One row per week 1 to 53 of each season; weeks that start in the next season are left out."""
    weeks = seasons.select(F.col(year).alias("season"), F.explode(F.sequence(F.lit(1), F.lit(53))).alias("week"))
    y, w = F.col("season"), F.col("week")
    out = weeks.select("season", "week", week_start(y, w, start).alias("start_date"), week_end(y, w, start).alias("end_date"), week_saturday(y, w, start).alias("saturday"))
    return out.where(F.col("start_date") < season_start(y + 1, start))


def saturdays(spark: SparkSession, first: str, last: str) -> DataFrame:
    """All Saturdays from the first date to the last."""
    days = F.sequence(F.next_day(F.date_sub(F.lit(first).cast("date"), 1), "SAT"), F.lit(last).cast("date"), F.expr("interval 7 days"))
    return spark.range(1).select(F.explode(days).alias("saturday"))


def season_saturdays(spans: DataFrame, first: str = "first", last: str = "last") -> DataFrame:
    """All Saturdays between the two dates of each row, once each."""
    days = F.sequence(F.next_day(F.date_sub(first, 1), "SAT"), F.col(last), F.expr("interval 7 days"))
    return spans.where(F.next_day(F.date_sub(first, 1), "SAT") <= F.col(last)).select(F.explode(days).alias("saturday")).distinct()


def first_epiweek_end(year: Column) -> Column:
    """Saturday that ends the year's first epidemiological week."""
    return F.next_day(F.make_date(year, F.lit(1), F.lit(3)), "SAT")


def epiweek_to_enddate(epiweek: Column) -> Column:
    year, week = (epiweek / 100).cast("int"), (epiweek % 100).cast("int")
    return F.date_add(first_epiweek_end(year), (week - 1) * 7)


def saturday_of(d: Column) -> Column:
    """The Saturday on or after a date."""
    return F.date_add(d, 7 - F.dayofweek(d))


def date_to_epiweek(d: Column) -> Column:
    sat = saturday_of(d)
    return (F.datediff(sat, first_epiweek_end(F.year(F.date_sub(sat, 3)))) / 7 + 1).cast("int")


def season_landmarks(calendar: DataFrame) -> DataFrame:
    """First, middle (index max(0, n // 2 - 1)) and last Saturday of each season."""
    days = calendar.groupBy("season").agg(F.sort_array(F.collect_list("saturday")).alias("s"))
    n = F.size("s")
    mid = F.greatest(F.lit(0), F.floor(n / 2).cast("int") - 1)
    return days.select("season", F.col("s")[0].alias("first_saturday"), F.get("s", mid).alias("mid_saturday"), F.get("s", n - 1).alias("last_saturday"))


def horizon_of(reference: Column, target_end: Column, first: int = 0) -> Column:
    """Weeks from the first Saturday on or after the reference date, counted from ``first``."""
    return (F.ceil(F.datediff(target_end, saturday_of(reference)) / 7) + first).cast("int")


def horizon_label(horizon: Column) -> Column:
    return F.format_string("%d wk ahead inc flu hosp", horizon)
