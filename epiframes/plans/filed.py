"""Queries: tables written to the shared folder by a sink and read back by its reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.seasons import date_to_epiweek, saturday_of
from ..schemas import RUNS as RUN_LOG
from ..sources import history as hs
from ..sources import readers as rd
from ..sources import sinks as sk
from ..sources.shared import shared_dir
from .bindings import HUB, OBS, TRAJ, TRUTH, hub, observations, query, r6, read, trajectories, truth
from .combined import RUNS, runs
from .framed import _EPI, _SATD, tensor_rows, _F17


@query("S01_read_truth", f"WITH {TRUTH} SELECT * FROM truth")
def _(spark, d):
    path = shared_dir(spark)
    truth(spark, d).select("value", F.concat(F.lit(" "), "location", F.lit(" ")).alias("location"), "date", F.lit("x").alias("location_name")).write.option("header", True).csv(path)
    return rd.read_truth(spark, path)


#: One submission a season, with all of the season's rows, keeps the number of files small.
_SEASON = "make_date(CAST(season AS INTEGER), 8, 1)"
_HUB_ROWS = f'WITH {HUB} SELECT model, {_SEASON} AS reference_date, target_end_date, location, horizon, output_type_id, round(value, 6) AS value FROM hub'


def _r(df):
    return df.withColumn("value", F.round("value", 6) + 0.0)


def _typed(df):
    return _r(df.select("model", F.col("reference_date").cast("date").alias("reference_date"), F.col("target_end_date").cast("date").alias("target_end_date"), "location", F.col("horizon").cast("int").alias("horizon"), F.col("output_type_id").cast("double").alias("output_type_id"), F.col("value").cast("double").alias("value")))


def by_season(spark, d):
    return hub(spark, d).withColumn("reference_date", F.make_date(F.col("season").cast("int"), F.lit(8), F.lit(1)))


def _hub_back(spark, d):
    path = shared_dir(spark)
    sk.write_hub_forecasts(by_season(spark, d), path)
    return rd.read_hub_forecasts(spark, path)


@query("S02_read_hub_forecasts", _HUB_ROWS.replace("SELECT model, make_date", f"SELECT model, {_SEASON} AS file_date, make_date"))
def _(spark, d):
    back = _hub_back(spark, d)
    return _r(back.select("model", "file_date", *[F.col(c).cast(t).alias(c) for c, t in (("reference_date", "date"), ("target_end_date", "date"), ("location", "string"), ("horizon", "int"), ("output_type_id", "double"), ("value", "double"))]))


query("S09_write_hub_forecasts", _HUB_ROWS)(lambda spark, d: _typed(_hub_back(spark, d)))


@query("S04_read_run_forecasts", f"WITH {HUB} SELECT 'i7::m_' || substr(model, 3) || '::inpaint_CoPaint::celebahq' AS model, location, horizon, target_end_date, output_type_id, round(value, 6) AS value FROM hub")
def _(spark, d):
    path = shared_dir(spark)
    name = F.concat(F.lit("i7::m_"), F.expr("substr(model, 3)"), F.lit("::inpaint_CoPaint::conf_celebahq::"), F.col("reference_date").cast("string"))
    sk.write_run_forecasts(by_season(spark, d).withColumn("folder", name).drop("model"), path)
    back = rd.read_run_forecasts(spark, path)
    return _r(back.select("model", "location", F.col("horizon").cast("int").alias("horizon"), F.col("target_end_date").cast("date").alias("target_end_date"), F.col("output_type_id").cast("double").alias("output_type_id"), F.col("value").cast("double").alias("value")))


@query("S05_read_trajectories", f"WITH {TRAJ} SELECT run_id AS model, location, date, sample_id, value FROM traj WHERE run_id NOT LIKE '%LOW%'")
def _(spark, d):
    path = shared_dir(spark)
    named = F.when(F.contains("run_id", F.lit("LOW")), F.concat("run_id", F.lit("example"))).otherwise(F.col("run_id"))
    sk.write_trajectories(trajectories(spark, d).withColumns({"model": named, "output_type": F.lit("sample")}).drop("run_id"), path)
    return rd.read_trajectories(spark, path).select("model", "location", "date", "sample_id", "value")


@query("S06_read_surveillance_csv", f"""WITH w AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d, CAST(l_suppkey % 4 AS VARCHAR) AS region, l_quantity AS q FROM lineitem),
e AS (SELECT CAST(year({_SATD} - 3) * 100 + {_EPI} AS INTEGER) AS epiweek, region, CAST({_SATD} AS DATE) AS week_enddate, q FROM w) SELECT epiweek, region, sum(q) AS value, week_enddate FROM e GROUP BY ALL""")
def _(spark, d):
    path = shared_dir(spark)
    rows = read(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("d"), (F.col("l_suppkey") % 4).cast("string").alias("region"), F.col("l_quantity").alias("q")).distinct()
    week = (F.year(F.date_sub(saturday_of(F.col("d")), 3)) * 100 + date_to_epiweek(F.col("d"))).cast("int")
    rows.groupBy(week.alias("epiweek"), "region").agg(F.sum("q").alias("value")).write.option("header", True).csv(path)
    return rd.read_surveillance_csv(spark, path, "value")


@query("S07_observations", f"WITH {OBS} SELECT datasetH1, datasetH2, fluseason, sample, location_code, season_week, week_enddate, value, round(fluseason_fraction, 4) AS fluseason_fraction FROM obs")
def _(spark, d):
    path = shared_dir(spark)
    sk.write_observations(observations(spark, d), path)
    return r6(rd.read_observations(spark, path))


_HISTORY = "datasetH1", "datasetH2", "fluseason", "sample", "location_code", "season_week", "value"


@query("U05_append_payload", f"WITH {OBS} SELECT {', '.join(_HISTORY[:-1])}, CASE WHEN fluseason = 1997 THEN value * 2 ELSE value END AS value FROM obs")
def _(spark, d):
    """All seasons are written, and 1997 is replaced by a payload twice, of which the second time changes nothing."""
    path = shared_dir(spark)
    rows = observations(spark, d).select(*_HISTORY)
    hs.write_seasons(rows, path)
    for _again in range(2):
        hs.replace_season(rows.withColumn("value", F.col("value") * 2), path, 1997)
    return hs.read_history(spark, path).select(*_HISTORY)


@query("S08_read_sample_tensors", f"""WITH {TRAJ}, w AS (SELECT run_id, location, date, dense_rank() OVER (PARTITION BY run_id, location ORDER BY date) - 1 AS i, dense_rank() OVER (PARTITION BY run_id, location ORDER BY sample_id) - 1 AS s, value FROM traj),
size AS (SELECT run_id, location, max(i) AS n, max(s) AS m FROM w GROUP BY ALL), cells AS (SELECT run_id, location, s, unnest(range(0, n + 1)) AS i FROM (SELECT run_id, location, n, unnest(range(0, m + 1)) AS s FROM size))
SELECT c.run_id || '/' || c.location AS file, CAST(c.s AS INTEGER) AS sample_id, 0 AS feature, CAST(c.i AS INTEGER) AS week_idx, 0 AS place, coalesce(w.value, 0) AS value FROM cells c LEFT JOIN w ON w.run_id = c.run_id AND w.location = c.location AND w.i = c.i AND w.s = c.s""")
def _(spark, d):
    """One .npy file a run and place, written by a sink and read back in byte ranges."""
    path = shared_dir(spark)
    sk.write_ensembles(trajectories(spark, d).withColumnRenamed("date", "week"), path)
    back = rd.read_sample_tensors(spark, path)
    return back.withColumn("file", F.regexp_replace("file", r"\.npy$", ""))


@query("S10_write_tensors", _F17.replace("SELECT frame_id, CAST(w AS INTEGER) AS w,", "SELECT frame_id, CAST(w AS INTEGER) AS w, 'mix' AS mix_cfg,"))
def _(spark, d):
    path = shared_dir(spark)
    sk.write_tensors(tensor_rows(spark, d), path, "mix")
    return spark.read.parquet(path)


@query("S11_read_run_log", f"WITH {RUNS} SELECT CAST(run_id AS VARCHAR) AS run_id, scenario_id, status, completed, final_loss FROM runs WHERE status = 'FINISHED'")
def _(spark, d):
    path = shared_dir(spark)
    runs(spark, d).write.json(path)
    return rd.read_run_log(spark, path, RUN_LOG).select("run_id", "scenario_id", "status", "completed", "final_loss")


@query("S12_write_summary_json", f"WITH {RUNS} SELECT scenario_id, count(*) AS n, max(final_loss) AS worst FROM runs GROUP BY ALL")
def _(spark, d):
    path = shared_dir(spark)
    sk.write_summary_json(runs(spark, d).groupBy("scenario_id").agg(F.count("*").alias("n"), F.max("final_loss").alias("worst")), path)
    return spark.read.schema("scenario_id int, n long, worst double").json(path)


@query("S13_read_locations", "SELECT s_name AS abbreviation, 'Place ' || s_suppkey AS location_name, CAST(s_nationkey * 1000 AS BIGINT) AS population, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS location_code FROM supplier")
def _(spark, d):
    path = shared_dir(spark)
    s = read(spark, d, "supplier")
    key = F.col("s_suppkey").cast("string")
    s.select(F.lpad(key, 6, "0").alias("location_code"), F.concat(F.lit(" "), "s_name").alias("abbreviation"), F.concat(F.lit("Place "), key).alias("location_name"), (F.col("s_nationkey") * 1000).alias("population")).write.option("header", True).csv(path)
    return rd.read_locations(spark, path).select("abbreviation", "location_name", "population", "location_code")
