"""Bringing sources into one long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes of the territories that are left out.
TERRITORIES = ("72", "60", "66", "69")


def clean_observations(df: DataFrame, axis: DataFrame) -> DataFrame:
    kept = df.select("week_enddate", "location_code", "value").join(F.broadcast(axis.select("location_code")), "location_code", "left_semi")
    return kept.dropna(subset=["value"])


def filter_locations(locations: DataFrame, territories: bool = True, national: bool = True) -> DataFrame:
    drop = (TERRITORIES if territories else ()) + (("US",) if national else ())
    return locations.where(~F.col("location_code").isin(*drop)) if drop else locations


def filter_sample_rows(df: DataFrame, target: str = "inc hosp", age: str = "0-130") -> DataFrame:
    return df.where((F.col("output_type") == "sample") & (F.col("target") == target) & (F.col("age_group") == age))


def trajectory_id(df: DataFrame) -> Column:
    """run_grouping, output_type_id and stochastic_run joined by _; null is NA, a column that is absent is left out."""
    parts = [c for c in ("run_grouping", "output_type_id", "stochastic_run") if c in df.columns]
    return F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in parts])


def horizon_to_date(origin: Column, horizon: Column) -> Column:
    return F.date_add(origin, horizon * 7)


def merge_subregions(df: DataFrame, parts: tuple[str, ...] = ("NY_albany", "NY_rochester"), whole: str = "NY", week: str = "week") -> DataFrame:
    """Rows of the parts summed into one region by week; the rest as it is."""
    numbers = [c for c, t in df.dtypes if t in ("double", "int", "bigint", "float") and c not in (week, "location")]
    merged = df.where(F.col("location").isin(*parts)).groupBy(week).agg(*[F.sum(c).alias(c) for c in numbers]).withColumn("location", F.lit(whole))
    return df.where(~F.col("location").isin(*parts)).unionByName(merged, allowMissingColumns=True)


def map_regions(region: Column, rest_of_state: bool = False) -> Column:
    """Upper case; JFK, and with the option the rest of the state, is NY."""
    up = F.upper(region)
    return F.when(up.isin("JFK", *(["NY_MINUS_JFK"] if rest_of_state else [])), "NY").otherwise(up)


def harmonize_weekly(df: DataFrame) -> DataFrame:
    from ..functions.seasons import add_season_columns

    renamed = df.withColumnsRenamed({"location": "location_code", "date": "week_enddate"}).drop("location_name", "weekly_rate")
    return add_season_columns(renamed, "week_enddate")


def harmonize_simulated(df: DataFrame) -> DataFrame:
    """Feature rows A and B added; null dates and empty places dropped; code from the place's first two characters."""
    kept = df.where("date IS NOT NULL AND place <> ''")
    wide = kept.groupBy("sample", "date", "place").pivot("feature", ["A", "B"]).agg(F.sum("value"))
    return wide.select("sample", F.col("date").alias("week_enddate"), F.substring("place", 1, 2).alias("location_code"), (F.col("A") + F.col("B")).alias("value"))


def melt_wide_weekly(tables: list[DataFrame], key: str, prefix: str = "NC_", without: str = "covid", rename: dict[str, str] | None = None) -> DataFrame:
    """Full join of wide weekly tables, columns holding ``without`` dropped, then long with prefixed series names."""
    wide = tables[0]
    for t in tables[1:]:
        wide = wide.join(t, key, "full")
    series = [c for c in wide.columns if c != key and without not in c.lower()]
    long = wide.unpivot([key], series, "series", "value").withColumn("series", F.concat(F.lit(prefix), F.col("series")))
    for a, b in (rename or {}).items():
        long = long.withColumn("series", F.when(F.col("series") == a, b).otherwise(F.col("series")))
    return long.where("value IS NOT NULL")


def tag_source(df: DataFrame, h1: str, h2: Column | str, sample: Column | str = "1") -> DataFrame:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.withColumns({"datasetH1": F.lit(h1), "datasetH2": as_col(h2), "sample": as_col(sample)})


def join_locations(df: DataFrame, locations: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Attach the location columns by abbreviation; ``full`` keeps both sides."""
    dim = locations.withColumnRenamed("abbreviation", on)
    return df.join(F.broadcast(dim) if how == "left" else dim, on, how)


def new_location_axis(df: DataFrame, locations: DataFrame) -> DataFrame:
    """Codes of the data with names, the code itself where there is none."""
    codes = df.select("location_code").distinct()
    return codes.join(F.broadcast(locations.select("location_code", "location_name")), "location_code", "left").withColumn("location_name", F.coalesce("location_name", "location_code"))


def source_coverage(axis: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    one, two = (x.select("location_code").distinct().withColumn(f"_{n}", F.lit(True)) for n, x in (("a", a), ("b", b)))
    j = axis.select("location_code").join(one, "location_code", "left").join(two, "location_code", "left")
    where = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "first").when(F.col("_b"), "second").otherwise("neither")
    return j.select("location_code", where.alias("coverage"))


def concat_features(a: DataFrame, b: DataFrame, date: str = "date") -> DataFrame:
    """Two feature tables on their common dates only."""
    shared = a.select(date).intersect(b.select(date))
    return a.join(shared, date, "left_semi").unionByName(b.join(shared, date, "left_semi"))


def union_sources(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def weekly_resample(df: DataFrame, date: str, keys: list[str]) -> DataFrame:
    """Sums by week ending on Sunday."""
    end = F.date_add(F.date_trunc("week", F.col(date)).cast("date"), 6)
    return df.groupBy(*keys, end.alias("week_end")).agg(F.sum("value").alias("value"))
