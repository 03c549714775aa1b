"""Observed data: padding, revisions and masks from a date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seasons import add_season_columns


def pad_calendar(truth: DataFrame, weeks: int = 52) -> DataFrame:
    """``weeks`` Saturdays from the first date for every location, with season columns; absent values are null."""
    first = truth.agg(F.min("date").alias("d0"))
    dates = first.select(F.explode(F.sequence("d0", F.date_add("d0", 7 * (weeks - 1)), F.expr("interval 7 days"))).alias("date"))
    # the calendar is the small side: ``weeks`` rows
    grid = truth.select("location").distinct().join(F.broadcast(dates))
    return add_season_columns(grid.join(truth, ["date", "location"], "left").select(*truth.columns), "date")


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, known: str, values: list[str]) -> DataFrame:
    """Each row of ``left`` with the ``values`` of the newest row of ``right`` of its keys whose ``known`` is at most its ``at``.

    A sort-merge in one pass: both sides are laid together, sorted by time within the keys, and the last known
    values are carried on to the rows that ask.  Of rows known at one time the one with the greatest values
    counts; rows without a time, or with null keys, know nothing and are matched with nothing; left rows all stay.
    """
    asks = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(at).cast("timestamp").alias("_t"), F.struct(*left.columns).alias("_row"))
    says = right.where(F.col(known).isNotNull()).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(known).cast("timestamp").alias("_t"), F.struct(*values).alias("_v"))
    names = [f"_k{i}" for i in range(len(keys))]
    both = asks.withColumn("_asks", F.lit(1)).unionByName(says.withColumn("_asks", F.lit(0)), allowMissingColumns=True)
    so_far = Window.partitionBy(*names).orderBy(F.col("_t").asc_nulls_first(), "_asks", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = F.lit(True)
    for k in names:
        whole = whole & F.col(k).isNotNull()
    got = both.withColumn("_got", F.when(whole, F.last("_v", True).over(so_far))).where("_asks = 1")
    return got.select("_row.*", *[F.col("_got")[v].alias(v) for v in values])


def truth_as_of(vintages: DataFrame, as_of: str | DataFrame, keys: tuple[str, ...] = ("location", "date"), reference: str = "reference_date") -> DataFrame:
    """The newest revision at the given time, or, with a table of reference dates, at each of them.

    A revision holds from its own time to the next one's; it goes to the reference dates between the two.  The
    dates are one sorted array (some days of some seasons), so there is one pass and no join with the revisions.
    """
    if isinstance(as_of, str):
        known = vintages.where(F.col("as_of") <= F.lit(as_of).cast("timestamp"))
        return known.groupBy(*keys).agg(F.max_by("value", "as_of").alias("value"))
    dates = as_of.agg(F.sort_array(F.collect_set(reference)).alias("_dates"))
    w = Window.partitionBy(*keys).orderBy("as_of", "value")
    held = vintages.where("as_of IS NOT NULL").withColumn("_until", F.lead("as_of").over(w)).join(F.broadcast(dates))
    inside = F.filter("_dates", lambda r: (r.cast("timestamp") >= F.col("as_of")) & (F.col("_until").isNull() | (r.cast("timestamp") < F.col("_until"))))
    return held.select(F.explode(inside).alias(reference), *keys, "value")


def final_vs_asof(vintages: DataFrame, as_of: str | DataFrame, keys: tuple[str, ...] = ("location", "date"), reference: str = "reference_date") -> DataFrame:
    """What was known at the time beside the final value; with a table of reference dates, for each of them and
    each date that is not after it."""
    final = vintages.groupBy(*keys).agg(F.max_by("value", F.struct("as_of", "value")).alias("final"))
    if isinstance(as_of, str):
        return truth_as_of(vintages, as_of, keys).withColumnRenamed("value", "as_of_value").join(final, list(keys), "full")
    dates = as_of.agg(F.sort_array(F.collect_set(reference)).alias("_dates"))
    past = F.filter("_dates", lambda r: r >= F.col(keys[-1]))
    asked = final.join(F.broadcast(dates)).select(F.explode(past).alias(reference), *keys, "final")
    return as_of_join(asked, vintages.withColumnRenamed("value", "as_of_value"), list(keys), reference, "as_of", ["as_of_value"])


def dedupe_history(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.dropDuplicates()


def append_payload(history: DataFrame, payload: DataFrame, season: int) -> DataFrame:
    """Other seasons of the history and the payload's rows of this season, as a table; on disk ``sources.history`` replaces
    that season's files alone."""
    return history.where(F.col("fluseason") != season).unionByName(payload.where(F.col("fluseason") == season))


def keep_mask_from_date(weeks: DataFrame, mask_date: str, date: str = "date") -> DataFrame:
    """Flag ``keep`` for weeks before the mask date, and how many; a mask date more than a week past the data
    moves to two days after its last date."""
    last = weeks.agg(F.max(date).alias("_last"))
    m = F.lit(mask_date).cast("date")
    when = F.when(m > F.date_add("_last", 7), F.date_add("_last", 2)).otherwise(m)
    flagged = weeks.join(F.broadcast(last)).withColumn("keep", (F.col(date) < when).cast("int")).drop("_last")
    return flagged


def season_overlay(rows: DataFrame, seasons: list[int]) -> DataFrame:
    """Seasons side by side by season week."""
    return rows.groupBy("season_week").pivot("fluseason", seasons).agg(F.sum("value"))
