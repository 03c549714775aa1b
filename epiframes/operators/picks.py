"""Picking dates, samples and rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def every_kth_date(df: DataFrame, date: str, k: int) -> DataFrame:
    """Each k-th of the sorted distinct dates."""
    d = df.select(date).distinct()
    return d.withColumn("_r", F.row_number().over(Window.orderBy(date)) - 1).where(F.col("_r") % k == 0).select(date)


def pick_spread(df: DataFrame, date: str, k: int, first: str | None = None, last: str | None = None) -> DataFrame:
    """At most k dates spread over the span: every max(1, n // k)-th."""
    d = df.select(date).distinct()
    d = d.where(F.col(date) >= F.lit(first).cast("date")) if first else d
    d = d.where(F.col(date) <= F.lit(last).cast("date")) if last else d
    r = d.withColumn("_r", F.row_number().over(Window.orderBy(date)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy()))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / k))
    return r.where((F.col("_r") % step == 0) & (F.col("_r") < k * step)).select(date)


def even_samples(samples: DataFrame, n: int, k: int) -> DataFrame:
    """k evenly spaced of n sample ids (from 0 to n - 1, fractions cut)."""
    wanted = sorted({int(i * (n - 1) / (k - 1)) if k > 1 else 0 for i in range(k)})
    return samples.where(F.col("sample_id").isin(*wanted))


def best_row(df: DataFrame, score: str, ties: str) -> DataFrame:
    return df.agg(F.min_by(F.struct("*"), F.struct(score, ties)).alias("b")).select("b.*")


def date_window(df: DataFrame, limits: dict[str, tuple[str, str]], date: str, season: str = "season") -> DataFrame:
    """Rows within their season's dates, both ends included."""
    hit = F.lit(False)
    for s, (a, b) in limits.items():
        hit = hit | ((F.col(season) == s) & F.col(date).between(F.lit(a).cast("date"), F.lit(b).cast("date")))
    return df.where(hit)


def place_to_code(df: DataFrame, locations: DataFrame, place: str = "place") -> DataFrame:
    """US, a code or an abbreviation as a code; anything else is an error raised by the row that has it."""
    dim = locations.select(F.col("abbreviation").alias(place), F.col("location_code").alias("_by_name"))
    codes = locations.select(F.col("location_code").alias(place), F.lit(True).alias("_is_code"))
    j = df.join(dim, place, "left").join(codes, place, "left")
    code = F.when((F.col(place) == "US") | F.col("_is_code"), F.col(place)).otherwise(F.col("_by_name"))
    bad = F.raise_error(F.concat(F.lit("unknown place: "), F.col(place)))
    return j.withColumn("location_code", F.coalesce(code, bad.cast("string"))).drop("_by_name", "_is_code")
