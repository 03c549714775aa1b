"""The library's tables bound to the test tables, once for Spark and once as SQL, row for row alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.seasons import saturday_of, season_fraction, season_week, season_year
from ..operators.hub import score_input
from ..operators.scoring import relative_score, score
from ..schemas import QUANTILES

BASELINE = "3-MEDIUM"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL twin if it has one."""

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def r6(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles rounded at the edge."""
    return df.select(*[(F.round(c, 4) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


SAT = "(CAST(l_shipdate AS DATE) + CAST(6 - dayofweek(CAST(l_shipdate AS DATE)) AS INTEGER))"
QS = "[" + ", ".join(map(str, QUANTILES)) + "]"


def season_sql(d: str) -> str:
    return f"CAST(year({d}) - CASE WHEN month({d}) < 8 THEN 1 ELSE 0 END AS INTEGER)"


def week_sql(d: str) -> str:
    return f"CAST(greatest(1, ({d} - make_date({season_sql(d)}, 8, 1)) // 7 + 1) AS INTEGER)"


OBS = f"""obs AS (
  SELECT * FROM (
    SELECT datasetH1, datasetH2, {season_sql('week_enddate')} AS fluseason, sample, location_code, {week_sql('week_enddate')} AS season_week, week_enddate, value,
      (week_enddate - make_date({season_sql('week_enddate')}, 8, 1)) / 365.0 AS fluseason_fraction
    FROM (SELECT l_returnflag AS datasetH1, l_returnflag || l_linestatus AS datasetH2, CAST(l_linenumber % 3 AS VARCHAR) AS sample,
      lpad(CAST(l_suppkey % 12 + 1 AS VARCHAR), 2, '0') AS location_code, CAST({SAT} AS DATE) AS week_enddate, sum(l_quantity) AS value
      FROM lineitem GROUP BY ALL))
  WHERE NOT (datasetH1 = 'R' AND location_code = '03') AND NOT (datasetH1 = 'N' AND location_code = '07' AND fluseason % 2 = 1))"""


def observations(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    day = F.to_date("l_shipdate")
    keys = {
        "datasetH1": F.col("l_returnflag"),
        "datasetH2": F.concat("l_returnflag", "l_linestatus"),
        "sample": (F.col("l_linenumber") % 3).cast("string"),
        "location_code": F.lpad((F.col("l_suppkey") % 12 + 1).cast("string"), 2, "0"),
        "week_enddate": saturday_of(day),
    }
    summed = li.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.sum("l_quantity").alias("value"))
    w = F.col("week_enddate")
    obs = summed.withColumns({"fluseason": season_year(w), "season_week": season_week(w), "fluseason_fraction": season_fraction(w)})
    drop = ((F.col("datasetH1") == "R") & (F.col("location_code") == "03")) | ((F.col("datasetH1") == "N") & (F.col("location_code") == "07") & (F.col("fluseason") % 2 == 1))
    return obs.where(~drop).select("datasetH1", "datasetH2", "fluseason", "sample", "location_code", "season_week", "week_enddate", "value", "fluseason_fraction")


TRUTH = f"""truth AS (
  SELECT location, date, value FROM (SELECT CAST(l_suppkey % 4 AS VARCHAR) AS location, CAST({SAT} AS DATE) AS date, l_extendedprice AS value,
    row_number() OVER (PARTITION BY l_suppkey % 4, {SAT} ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS r FROM lineitem) WHERE r = 1)"""
_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def truth(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").select((F.col("l_suppkey") % 4).cast("string").alias("location"), saturday_of(F.to_date("l_shipdate")).alias("date"), F.struct(*_ORDER).alias("k"))
    return li.groupBy("location", "date").agg(F.min("k").alias("k")).select("location", "date", F.col("k.l_extendedprice").alias("value"))


SAMPLES = f"""samples AS (
  SELECT o_orderpriority AS model, CAST(l_suppkey % 4 AS VARCHAR) AS location, CAST({SAT} AS DATE) AS target_end_date,
    CAST(row_number() OVER (PARTITION BY o_orderpriority, l_suppkey % 4, {SAT} ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS INTEGER) AS sample_id, l_extendedprice AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def samples(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("model"))
    li = read(spark, d, "lineitem").select(*_ORDER, (F.col("l_suppkey") % 4).cast("string").alias("location"), saturday_of(F.to_date("l_shipdate")).alias("target_end_date"))
    w = Window.partitionBy("model", "location", "target_end_date").orderBy(*_ORDER)
    return li.join(o, "l_orderkey").select("model", "location", "target_end_date", F.row_number().over(w).alias("sample_id"), F.col("l_extendedprice").alias("value"))


TRAJ = f"""traj AS (
  SELECT o_orderpriority AS run_id, CAST(l_suppkey % 12 AS VARCHAR) AS location, CAST({SAT} AS DATE) AS date, CAST(l_orderkey % 40 AS INTEGER) AS sample_id, sum(l_quantity) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""


def trajectories(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("run_id"))
    li = read(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 12).cast("string").alias("location"), saturday_of(F.to_date("l_shipdate")).alias("date"), (F.col("l_orderkey") % 40).cast("int").alias("sample_id"), "l_quantity")
    return li.join(o, "l_orderkey").groupBy("run_id", "location", "date", "sample_id").agg(F.sum("l_quantity").alias("value"))


HUB = f"""{SAMPLES}, hub AS (
  SELECT model, "group", season, reference_date, target_end_date, location, horizon, 'wk inc flu hosp' AS target, 'quantile' AS output_type, q AS output_type_id, value FROM (
    SELECT model, CASE WHEN substr(model, 1, 1) <= '2' THEN 'a' ELSE 'b' END AS "group", CAST({season_sql('target_end_date')} AS VARCHAR) AS season,
      CAST(target_end_date - CAST(7 * (((target_end_date - DATE '1995-01-07') // 7) % 4) AS INTEGER) AS DATE) AS reference_date, target_end_date, location,
      CAST(((target_end_date - DATE '1995-01-07') // 7) % 4 AS INTEGER) AS horizon, unnest({QS}) AS q, unnest(quantile_cont(value, {QS})) AS value
    FROM samples GROUP BY model, location, target_end_date))"""


def hub_of(samples_df: DataFrame) -> DataFrame:
    from ..operators.forecasts import ensemble_quantiles

    t = F.col("target_end_date")
    h = (F.floor(F.datediff(t, F.lit("1995-01-07").cast("date")) / 7) % 4).cast("int")
    q = ensemble_quantiles(samples_df, ["model", "location", "target_end_date"])
    return q.select(
        "model", F.when(F.substring("model", 1, 1) <= "2", "a").otherwise("b").alias("group"), season_year(t).cast("string").alias("season"), F.date_sub(t, h * 7).alias("reference_date"),
        "target_end_date", "location", h.alias("horizon"), F.lit("wk inc flu hosp").alias("target"), F.lit("quantile").alias("output_type"), F.col("quantile").alias("output_type_id"), "value",
    )


def hub(spark: SparkSession, d: str) -> DataFrame:
    return hub_of(samples(spark, d))


JOINED = f"""{HUB}, {TRUTH}, joined AS (
  SELECT h.model, h."group", h.season, h.reference_date, h.target_end_date, h.location, h.horizon, h.output_type_id AS quantile, h.value AS predicted, t.value AS observed
  FROM hub h JOIN truth t ON h.target_end_date = t.date AND h.location = t.location)"""


def joined(spark: SparkSession, d: str) -> DataFrame:
    return score_input(hub(spark, d), truth(spark, d))


UNIT_SQL = 'model, "group", season, reference_date, target_end_date, location, horizon'
SCORES = f"""{JOINED}, units AS (
  SELECT {UNIT_SQL}, avg(2 * (CASE WHEN observed < predicted THEN 1 ELSE 0 END - quantile) * (predicted - observed)) AS wis,
    sum(CASE WHEN quantile < 0.5 THEN -quantile * predicted WHEN quantile > 0.5 THEN (1 - quantile) * predicted ELSE 0 END) / 11.5 AS dispersion,
    sum(CASE WHEN quantile < 0.5 THEN greatest(predicted - observed, 0) WHEN quantile = 0.5 THEN 0.5 * greatest(predicted - observed, 0) ELSE 0 END) / 11.5 AS overprediction,
    sum(CASE WHEN quantile > 0.5 THEN greatest(observed - predicted, 0) WHEN quantile = 0.5 THEN 0.5 * greatest(observed - predicted, 0) ELSE 0 END) / 11.5 AS underprediction,
    CAST(max(CASE WHEN quantile = 0.25 THEN predicted END) <= max(observed) AND max(observed) <= max(CASE WHEN quantile = 0.75 THEN predicted END) AS DOUBLE) AS interval_coverage_50,
    CAST(max(CASE WHEN quantile = 0.05 THEN predicted END) <= max(observed) AND max(observed) <= max(CASE WHEN quantile = 0.95 THEN predicted END) AS DOUBLE) AS interval_coverage_90,
    max(CASE WHEN quantile = 0.5 THEN abs(observed - predicted) END) AS ae_median,
    CASE WHEN max(observed) = max(CASE WHEN quantile = 0.5 THEN predicted END) THEN 0.0
      WHEN max(observed) < max(CASE WHEN quantile = 0.5 THEN predicted END) THEN coalesce(1 - 2 * max(CASE WHEN predicted <= observed THEN quantile END), 1.0)
      ELSE coalesce(1 - 2 * min(CASE WHEN predicted >= observed THEN quantile END), -1.0) END AS bias
  FROM joined GROUP BY {UNIT_SQL}),
scores AS (SELECT u.*, CASE WHEN b.wis > 0 THEN u.wis / b.wis END AS relative_wis FROM units u
  LEFT JOIN (SELECT location, target_end_date, horizon, min(wis) AS wis FROM units WHERE model = '{BASELINE}' GROUP BY ALL) b
  ON u.location = b.location AND u.target_end_date = b.target_end_date AND u.horizon = b.horizon)"""


def scores(spark: SparkSession, d: str) -> DataFrame:
    return relative_score(score(joined(spark, d)), BASELINE)
