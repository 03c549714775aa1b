"""Queries: harmonizing, truth and revisions, experiments, masks and picks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names as nm
from ..functions import seasons as se
from ..operators import experiments as ex
from ..operators import harmonize as hz
from ..operators import masks as mk
from ..operators import picks as pk
from ..operators import truth as tu
from .bindings import HUB, OBS, QS, SAT, SCORES, TRAJ, TRUTH, hub, observations, query, r6, read, scores, season_sql, trajectories, truth, week_sql
from .framed import axis, placed_axis

# revisions, locations and run logs from events, nation and orders
VINT = "vint AS (SELECT CAST(user_id % 12 AS VARCHAR) AS location, CAST(ts AS DATE) AS date, ts AS as_of, arg_min(value, event_id) AS value FROM events GROUP BY ALL)"


def vintages(spark, d):
    e = read(spark, d, "events")
    return e.groupBy((F.col("user_id") % 12).cast("string").alias("location"), F.to_date("ts").alias("date"), F.col("ts").alias("as_of")).agg(F.min_by("value", "event_id").alias("value"))


LOC = "loc AS (SELECT n_name AS abbreviation, 'Place ' || n_nationkey AS location_name, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS location_code FROM nation)"


def locations(spark, d):
    n = read(spark, d, "nation")
    return n.select(F.col("n_name").alias("abbreviation"), F.concat(F.lit("Place "), F.col("n_nationkey").cast("string")).alias("location_name"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("location_code"))


STEPS = "steps AS (SELECT CAST(user_id AS VARCHAR) AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value AS loss, event_type, ts FROM events)"


def steps(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), F.row_number().over(w).cast("long").alias("step"), F.col("value").alias("loss"), "event_type", "ts")


RUNS = """runs AS (SELECT CAST(o_custkey % 17 AS INTEGER) AS scenario_id, o_orderpriority AS config, CAST(o_orderdate AS DATE) AS date, o_totalprice AS mean, o_totalprice % 1000 AS std, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS completed,
CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS final_loss, CAST(o_orderkey % 512 AS INTEGER) AS num_samples, o_orderkey AS run_id, o_orderdate AS start_time, CASE WHEN o_orderstatus = 'F' THEN 'FINISHED' ELSE 'FAILED' END AS status FROM orders)"""


def runs(spark, d):
    o = read(spark, d, "orders")
    done = F.col("o_orderstatus") == "F"
    return o.select(
        (F.col("o_custkey") % 17).cast("int").alias("scenario_id"), F.col("o_orderpriority").alias("config"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("mean"), (F.col("o_totalprice") % 1000).alias("std"),
        done.cast("int").alias("completed"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("final_loss"), (F.col("o_orderkey") % 512).cast("int").alias("num_samples"),
        F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("start_time"), F.when(done, "FINISHED").otherwise("FAILED").alias("status"),
    )


# harmonizing


@query("P01_clean_observations", f"WITH {OBS} SELECT location_code, week_enddate, value FROM obs WHERE season_week NOT IN (10, 11)")
def _(spark, d):
    """Week 10 has no values and week 11 lies off the axis."""
    o = observations(spark, d).withColumn("value", F.when(F.col("season_week") != 10, F.col("value")))
    o = o.withColumn("location_code", F.when(F.col("season_week") == 11, "99").otherwise(F.col("location_code")))
    return hz.clean_observations(o, axis(spark, d))


@query("P02_filter_locations", f"WITH {LOC} SELECT abbreviation, location_code FROM loc WHERE location_code NOT IN ('72', '60', '66', '69', 'US')")
def _(spark, d):
    extra = spark.createDataFrame([("PR", "72"), ("US", "US")], "abbreviation string, location_code string")
    return hz.filter_locations(locations(spark, d).select("abbreviation", "location_code").union(extra))


def _sampled(spark, d):
    """Scenario-hub rows bound to line items."""
    li = read(spark, d, "lineitem")
    return li.select(
        F.to_date("l_shipdate").alias("origin_date"), F.when(F.col("l_returnflag") == "A", "sample").otherwise("quantile").alias("output_type"), F.when(F.col("l_linestatus") == "O", "inc hosp").otherwise("cum hosp").alias("target"),
        F.when(F.col("l_linenumber") == 1, "0-17").otherwise("0-130").alias("age_group"), F.col("l_linenumber").alias("horizon"), F.when(F.col("l_linenumber") != 2, F.col("l_suppkey")).alias("run_grouping"), F.col("l_partkey").alias("stochastic_run"),
    )


_SAM = """sam AS (SELECT CAST(l_shipdate AS DATE) AS origin_date, CASE WHEN l_returnflag = 'A' THEN 'sample' ELSE 'quantile' END AS output_type, CASE WHEN l_linestatus = 'O' THEN 'inc hosp' ELSE 'cum hosp' END AS target,
CASE WHEN l_linenumber = 1 THEN '0-17' ELSE '0-130' END AS age_group, l_linenumber AS horizon, CASE WHEN l_linenumber <> 2 THEN l_suppkey END AS run_grouping, l_partkey AS stochastic_run FROM lineitem)"""


@query("P04_filter_sample_rows", f"WITH {_SAM} SELECT horizon, count(*) AS n FROM sam WHERE output_type = 'sample' AND target = 'inc hosp' AND age_group = '0-130' GROUP BY ALL")
def _(spark, d):
    return hz.filter_sample_rows(_sampled(spark, d)).groupBy("horizon").agg(F.count("*").alias("n"))


@query("P05_trajectory_id", f"WITH {_SAM} SELECT coalesce(CAST(run_grouping AS VARCHAR), 'NA') || '_' || stochastic_run AS sample, count(*) AS n FROM sam GROUP BY ALL")
def _(spark, d):
    s = _sampled(spark, d)
    return s.groupBy(hz.trajectory_id(s).alias("sample")).agg(F.count("*").alias("n"))


@query("P06_horizon_to_date", f"WITH {_SAM} SELECT origin_date, horizon, CAST(origin_date + CAST(7 * horizon AS INTEGER) AS DATE) AS week_enddate, count(*) AS n FROM sam GROUP BY ALL")
def _(spark, d):
    s = _sampled(spark, d)
    return s.groupBy("origin_date", "horizon", hz.horizon_to_date(F.col("origin_date"), F.col("horizon")).alias("week_enddate")).agg(F.count("*").alias("n"))


_REG = "reg AS (SELECT season_week AS week, CASE location_code WHEN '01' THEN 'NY_albany' WHEN '02' THEN 'NY_rochester' ELSE 'x' || location_code END AS location, sum(value) AS value FROM obs GROUP BY ALL)"


def _regions(spark, d):
    c = F.col("location_code")
    name = F.when(c == "01", "NY_albany").when(c == "02", "NY_rochester").otherwise(F.concat(F.lit("x"), c))
    return observations(spark, d).groupBy(F.col("season_week").alias("week"), name.alias("location")).agg(F.sum("value").alias("value"))


@query("P07_merge_ny_subregions", f"WITH {OBS}, {_REG} SELECT week, location, value FROM reg WHERE location NOT LIKE 'NY%' UNION ALL SELECT week, 'NY', sum(value) FROM reg WHERE location LIKE 'NY%' GROUP BY week")
def _(spark, d):
    return hz.merge_subregions(_regions(spark, d)).select("week", "location", "value")


@query("P08_map_fluview_regions", "SELECT c_custkey AS k, CASE WHEN upper(r) = 'JFK' THEN 'NY' ELSE upper(r) END AS region FROM (SELECT c_custkey, ['jfk', 'ny_minus_jfk', 'ca', 'Tx'][c_custkey % 4 + 1] AS r FROM customer)")
def _(spark, d):
    r = F.lit(["jfk", "ny_minus_jfk", "ca", "Tx"])[(F.col("c_custkey") % 4).cast("int")]
    return read(spark, d, "customer").select(F.col("c_custkey").alias("k"), hz.map_regions(r).alias("region"))


@query("P09_harmonize_nhsn", f"WITH {TRUTH} SELECT location AS location_code, date AS week_enddate, value, {season_sql('date')} AS fluseason, {week_sql('date')} AS season_week, round((date - make_date({season_sql('date')}, 8, 1)) / 365.0, 4) AS fluseason_fraction FROM truth")
def _(spark, d):
    return r6(hz.harmonize_weekly(truth(spark, d).withColumns({"location_name": F.lit("x"), "weekly_rate": F.lit(1.0)})))


@query("P10_harmonize_simulated", f"""WITH {OBS}, s AS (SELECT sample, week_enddate AS date, location_code || '000' AS place, sum(CASE WHEN datasetH1 = 'A' THEN value END) AS a, sum(CASE WHEN datasetH1 = 'N' THEN value END) AS b FROM obs WHERE datasetH1 IN ('A', 'N') GROUP BY ALL)
SELECT sample, date AS week_enddate, substr(place, 1, 2) AS location_code, a + b AS value FROM s""")
def _(spark, d):
    o = observations(spark, d).where("datasetH1 IN ('A', 'N')")
    return hz.harmonize_simulated(o.select("sample", F.col("week_enddate").alias("date"), F.concat("location_code", F.lit("000")).alias("place"), F.when(F.col("datasetH1") == "A", "A").otherwise("B").alias("feature"), "value"))


_WIDE = "w1 AS (SELECT season_week AS week, sum(CASE WHEN location_code = '01' THEN value END) AS flu, sum(CASE WHEN location_code = '02' THEN value END) AS Covid19 FROM obs GROUP BY ALL), w2 AS (SELECT season_week AS week, sum(CASE WHEN location_code = '04' THEN value END) AS rsv FROM obs WHERE season_week > 20 GROUP BY ALL)"


@query("P11_melt_wide_weekly", f"WITH {OBS}, {_WIDE}, j AS (SELECT coalesce(w1.week, w2.week) AS week, flu, rsv FROM w1 FULL JOIN w2 ON w1.week = w2.week) SELECT week, 'flu' AS series, flu AS value FROM j WHERE flu IS NOT NULL UNION ALL SELECT week, 'NC_rsv', rsv FROM j WHERE rsv IS NOT NULL")
def _(spark, d):
    o = observations(spark, d).withColumnRenamed("season_week", "week")
    at = lambda c: F.sum(F.when(F.col("location_code") == c, F.col("value")))
    w1 = o.groupBy("week").agg(at("01").alias("flu"), at("02").alias("Covid19"))
    w2 = o.where("week > 20").groupBy("week").agg(at("04").alias("rsv"))
    return hz.melt_wide_weekly([w1, w2], "week", rename={"NC_flu": "flu"})


@query("P12_tag_source", f"WITH {TRUTH} SELECT 'nhsn' AS datasetH1, 'nhsn_' || location AS datasetH2, '1' AS sample, count(*) AS n FROM truth GROUP BY ALL")
def _(spark, d):
    return hz.tag_source(truth(spark, d), "nhsn", F.concat_ws("_", F.lit("nhsn"), "location")).groupBy("datasetH1", "datasetH2", "sample").agg(F.count("*").alias("n"))


@query("P15_date_window", f"WITH {HUB} SELECT season, count(*) AS n FROM hub WHERE (season = '1996' AND target_end_date BETWEEN DATE '1996-10-12' AND DATE '1997-03-01') OR (season = '1997' AND target_end_date BETWEEN DATE '1997-11-01' AND DATE '1998-02-07') GROUP BY ALL")
def _(spark, d):
    return pk.date_window(hub(spark, d), {"1996": ("1996-10-12", "1997-03-01"), "1997": ("1997-11-01", "1998-02-07")}, "target_end_date").groupBy("season").agg(F.count("*").alias("n"))


# joins


@query("J01_join_locations", f"WITH {LOC} SELECT c_custkey, abbreviation, location_code, location_name FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'none' ELSE 'NATION_' || c_nationkey END AS k FROM customer) LEFT JOIN loc ON k = abbreviation")
def _(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "none").otherwise(F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))).alias("fips"))
    j = hz.join_locations(c, locations(spark, d), "fips")
    return j.select("c_custkey", F.when(F.col("location_code").isNotNull(), F.col("fips")).alias("abbreviation"), "location_code", "location_name")


@query("J02_join_locations_outer", f"WITH {LOC}, c AS (SELECT 'NATION_' || (c_nationkey + 3) AS fips, count(*) AS n FROM customer GROUP BY ALL) SELECT coalesce(fips, abbreviation) AS fips, n, location_code FROM c FULL JOIN loc ON fips = abbreviation")
def _(spark, d):
    c = read(spark, d, "customer").groupBy(F.concat(F.lit("NATION_"), (F.col("c_nationkey") + 3).cast("string")).alias("fips")).agg(F.count("*").alias("n"))
    return hz.join_locations(c, locations(spark, d), "fips", "full").select("fips", "n", "location_code")


@query("J03_new_location_axis", f"WITH {OBS}, {LOC} SELECT DISTINCT o.location_code, coalesce(location_name, o.location_code) AS location_name FROM obs o LEFT JOIN loc ON loc.location_code = o.location_code AND loc.location_code < '06'")
def _(spark, d):
    return hz.new_location_axis(observations(spark, d), locations(spark, d).where("location_code < '06'"))


@query("J06_pad_calendar", f"""WITH {TRUTH}, f AS (SELECT min(date) AS d0 FROM truth), g AS (SELECT location, CAST(d0 + CAST(7 * i AS INTEGER) AS DATE) AS date FROM (SELECT DISTINCT location FROM truth), f, (SELECT unnest(range(0, 52)) AS i))
SELECT g.date, g.location, t.value, {season_sql('g.date')} AS fluseason, {week_sql('g.date')} AS season_week, round((g.date - make_date({season_sql('g.date')}, 8, 1)) / 365.0, 4) AS fluseason_fraction FROM g LEFT JOIN truth t ON t.date = g.date AND t.location = g.location""")
def _(spark, d):
    return r6(tu.pad_calendar(truth(spark, d)))


# truth that is revised for up to sixty days; forecasts are compared with what is known 35 days after their reference date
REVS = f"""revs AS (SELECT location, date, CAST(date + CAST(lag AS INTEGER) AS TIMESTAMP) AS as_of, arg_min(value, k) AS value FROM (SELECT CAST(l_suppkey % 4 AS VARCHAR) AS location, CAST({SAT} AS DATE) AS date, l_partkey % 60 AS lag, l_extendedprice AS value,
  (l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem) GROUP BY ALL)"""


def revisions(spark, d):
    order = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    li = read(spark, d, "lineitem").select((F.col("l_suppkey") % 4).cast("string").alias("location"), se.saturday_of(F.to_date("l_shipdate")).alias("date"), (F.col("l_partkey") % 60).cast("int").alias("lag"), F.struct(*order).alias("k"))
    first = li.groupBy("location", "date", "lag").agg(F.min("k").alias("k"))
    return first.select("location", "date", F.date_add("date", F.col("lag")).cast("timestamp").alias("as_of"), F.col("k.l_extendedprice").alias("value"))


_REFS = "refs AS MATERIALIZED (SELECT DISTINCT reference_date FROM hub)"


@query("J07_truth_as_of", f"WITH {HUB}, {_REFS}, {REVS} SELECT reference_date, location, date, arg_max(value, as_of) AS value FROM revs JOIN refs ON as_of <= reference_date GROUP BY ALL")
def _(spark, d):
    return tu.truth_as_of(revisions(spark, d), hub(spark, d).select("reference_date"))


@query("J07_forecasts_as_of", f"""WITH {HUB}, {REVS}, f AS (SELECT model, location, reference_date, target_end_date, horizon, value AS predicted, CAST(reference_date + 35 AS TIMESTAMP) AS judged FROM hub WHERE round(output_type_id, 6) = 0.5)
SELECT model, f.location, reference_date, target_end_date, horizon, round(predicted, 4) AS predicted, value AS observed FROM f ASOF LEFT JOIN revs ON f.location = revs.location AND f.target_end_date = revs.date AND f.judged >= revs.as_of""")
def _(spark, d):
    f = hub(spark, d).where("round(output_type_id, 6) = 0.5").select("model", "location", "reference_date", F.col("target_end_date").alias("date"), "horizon", F.col("value").alias("predicted"), F.date_add("reference_date", 35).alias("judged"))
    j = tu.as_of_join(f, revisions(spark, d).withColumnRenamed("value", "observed"), ["location", "date"], "judged", "as_of", ["observed"])
    return r6(j.drop("judged").withColumnRenamed("date", "target_end_date"))


@query("J08_final_vs_asof", f"""WITH {HUB}, {_REFS}, {REVS}, fin AS (SELECT location, date, arg_max(value, as_of) AS final FROM revs GROUP BY ALL), a AS (SELECT reference_date, location, date, arg_max(value, as_of) AS as_of_value FROM revs JOIN refs ON as_of <= reference_date GROUP BY ALL)
SELECT r.reference_date, fin.location, fin.date, as_of_value, final FROM fin JOIN refs r ON r.reference_date >= fin.date LEFT JOIN a ON a.reference_date = r.reference_date AND a.location = fin.location AND a.date = fin.date""")
def _(spark, d):
    return tu.final_vs_asof(revisions(spark, d), hub(spark, d).select("reference_date"))


@query("J15_source_coverage", f"""WITH {OBS}, a AS (SELECT DISTINCT location_code FROM obs WHERE datasetH1 = 'R' AND location_code < '09'), b AS (SELECT DISTINCT location_code FROM obs WHERE datasetH1 = 'N' AND location_code > '02'), x AS (SELECT DISTINCT location_code FROM obs)
SELECT location_code, CASE WHEN location_code IN (SELECT * FROM a) AND location_code IN (SELECT * FROM b) THEN 'both' WHEN location_code IN (SELECT * FROM a) THEN 'first' WHEN location_code IN (SELECT * FROM b) THEN 'second' ELSE 'neither' END AS coverage FROM x""")
def _(spark, d):
    o = observations(spark, d)
    return hz.source_coverage(o.select("location_code").distinct(), o.where("datasetH1 = 'R' AND location_code < '09'"), o.where("datasetH1 = 'N' AND location_code > '02'"))


@query("J18_concat_features", f"WITH {OBS}, a AS (SELECT week_enddate AS date, 'A' AS feature, sum(value) AS value FROM obs WHERE datasetH1 = 'A' GROUP BY ALL), b AS (SELECT week_enddate AS date, 'R' AS feature, sum(value) AS value FROM obs WHERE datasetH1 = 'R' AND fluseason > 1996 GROUP BY ALL) SELECT * FROM a WHERE date IN (SELECT date FROM b) UNION ALL SELECT * FROM b WHERE date IN (SELECT date FROM a)")
def _(spark, d):
    o = observations(spark, d)
    f = lambda x, n: x.groupBy(F.col("week_enddate").alias("date")).agg(F.sum("value").alias("value")).select("date", F.lit(n).alias("feature"), "value")
    return hz.concat_features(f(o.where("datasetH1 = 'A'"), "A"), f(o.where("datasetH1 = 'R' AND fluseason > 1996"), "R"))


@query("U01_union_sources", f"WITH {OBS} SELECT datasetH1, count(*) AS n, count(extra) AS n_extra FROM (SELECT datasetH1, value, NULL AS extra FROM obs WHERE datasetH1 = 'A' UNION ALL SELECT datasetH1, value, 1 FROM obs WHERE datasetH1 = 'N') GROUP BY ALL")
def _(spark, d):
    o = observations(spark, d).select("datasetH1", "value")
    return hz.union_sources(o.where("datasetH1 = 'A'"), o.where("datasetH1 = 'N'").withColumn("extra", F.lit(1))).groupBy("datasetH1").agg(F.count("*").alias("n"), F.count("extra").alias("n_extra"))


@query("U02_dedupe_history", f"WITH {TRUTH} SELECT location, count(*) AS n FROM (SELECT * FROM truth UNION SELECT * FROM truth) GROUP BY ALL")
def _(spark, d):
    t = truth(spark, d)
    return tu.dedupe_history(t, t).groupBy("location").agg(F.count("*").alias("n"))


@query("U05_append_payload_table", f"WITH {OBS} SELECT fluseason, location_code, week_enddate, datasetH2, sample, CASE WHEN fluseason = 1997 THEN value * 2 ELSE value END AS value FROM obs")
def _(spark, d):
    o = observations(spark, d).select("fluseason", "location_code", "week_enddate", "datasetH2", "sample", "value")
    return tu.append_payload(o, o.withColumn("value", F.col("value") * 2), 1997)


@query("A32_weekly_resample", "SELECT CAST(user_id % 3 AS VARCHAR) AS k, CAST(date_trunc('week', ts) AS DATE) + 6 AS week_end, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def _(spark, d):
    e = read(spark, d, "events").select((F.col("user_id") % 3).cast("string").alias("k"), F.col("ts"), "value")
    return r6(hz.weekly_resample(e, "ts", ["k"]))


# experiments



def _grid_sql() -> str:
    total, cols = 1280, []
    for name, values in ex.OPTIONS.items():
        total //= len(values)
        cols.append(f"[{', '.join(repr(v) for v in values)}][CAST((id // {total}) % {len(values)} AS INTEGER) + 1] AS {name}")
    return f"grid AS (SELECT CAST(id AS INTEGER) AS scenario_id, {', '.join(cols)} FROM (SELECT unnest(range(0, 1280)) AS id))"


GRID = _grid_sql()
_CHANGED = " + ".join(f"CASE WHEN {c} <> '{v}' THEN 1 ELSE 0 END" for c, v in ex.BASELINE.items())


@query("J12_scenario_grid", f"WITH {GRID}, {RUNS} SELECT g.*, coalesce(n, 0) AS n FROM grid g LEFT JOIN (SELECT scenario_id, count(*) AS n FROM runs GROUP BY ALL) r ON r.scenario_id = g.scenario_id")
def _(spark, d):
    done = runs(spark, d).groupBy("scenario_id").agg(F.count("*").alias("n"))
    return ex.scenario_grid(spark).join(done, "scenario_id", "left").fillna(0, ["n"])


_ESS = f"ess AS (SELECT *, row_number() OVER (ORDER BY scenario_id) - 1 AS i FROM grid WHERE {_CHANGED} <= 1)"


def essential(spark):
    return ex.essential_scenarios(ex.scenario_grid(spark))


def _essential_runs(spark, d):
    e = essential(spark).withColumn("i", F.row_number().over(Window.orderBy("scenario_id")) - 1)
    return runs(spark, d).withColumnRenamed("scenario_id", "i").join(F.broadcast(e), "i").drop("i")


_ERUNS = f"{GRID}, {_ESS}, {RUNS}, eruns AS (SELECT e.scenario_id, ddpm_name, unet_name, dataset_name, transform_name, enrich_name, r.* EXCLUDE (scenario_id) FROM runs r JOIN ess e ON e.i = r.scenario_id)"


@query("J13_essential_scenarios", f"WITH {_ERUNS} SELECT scenario_id, ddpm_name, unet_name, dataset_name, transform_name, enrich_name, run_id FROM eruns")
def _(spark, d):
    return _essential_runs(spark, d).select("scenario_id", *ex.OPTIONS, "run_id")


_JOBS = f"""jobs AS (SELECT *, CAST(row_number() OVER (ORDER BY scenario_id, date, pos) AS INTEGER) AS job_id FROM (SELECT m.scenario_id, m.run_id, s.season, CAST(unnest(generate_series(s.a, s.b, INTERVAL 14 DAY)) AS DATE) AS date, c.config, c.pos
FROM (SELECT scenario_id, max(run_id) AS run_id FROM runs GROUP BY scenario_id) m, (VALUES ('1996', TIMESTAMP '1996-10-12', TIMESTAMP '1997-04-26'), ('1997', TIMESTAMP '1997-10-11', TIMESTAMP '1998-04-25')) s(season, a, b), (VALUES ('celebahq_noTTJ5', 1), ('celebahq_try3', 2), ('celebahq', 3)) c(config, pos)))"""


def jobs(spark, d):
    models = runs(spark, d).groupBy("scenario_id").agg(F.max("run_id").alias("run_id"))
    return ex.job_grid(models, {"1996": ("1996-10-12", "1997-04-26"), "1997": ("1997-10-11", "1998-04-25")})


@query("J11_job_grid", f"WITH {RUNS}, {_JOBS} SELECT job_id, scenario_id, run_id, season, date, config FROM jobs")
def _(spark, d):
    return jobs(spark, d).select("job_id", "scenario_id", "run_id", "season", "date", "config")


@query("J09_remaining_jobs", f"WITH {RUNS}, {_JOBS} SELECT job_id, scenario_id FROM jobs WHERE NOT (scenario_id % 2 = 0 AND season = '1996')")
def _(spark, d):
    j = jobs(spark, d)
    return ex.remaining_jobs(j, j.where("scenario_id % 2 = 0 AND season = '1996'")).select("job_id", "scenario_id")


def _folder(c: str):
    return F.concat(F.lit("i"), F.col("scenario_id").cast("string"), F.lit("::m_x::ds_y::tr_Sqrt::ri_No::inpaint_CoPaint::conf_"), F.col(c), F.lit("::"), F.col("date").cast("string"))


@query("J10_failed_jobs", f"WITH {RUNS}, {_JOBS} SELECT job_id, season FROM jobs WHERE scenario_id % 5 = 1")
def _(spark, d):
    j = jobs(spark, d)
    folders = j.where("scenario_id % 5 = 1").select(_folder("config").alias("folder"))
    return ex.failed_jobs(folders.union(folders), j).select("job_id", "season")


@query("A33_failed_by_season", f"WITH {RUNS}, {_JOBS} SELECT season, count(*) AS n FROM jobs WHERE scenario_id % 5 = 1 GROUP BY ALL")
def _(spark, d):
    return ex.failed_by_season(jobs(spark, d).where("scenario_id % 5 = 1"))


BOARD17 = f"{_ERUNS}, b17 AS (SELECT scenario_id, 'i' || scenario_id || '::m_x::inpaint_CoPaint::celebahq_' || lower(substr(config, 3)) AS model, ddpm_name, unet_name, dataset_name, transform_name, enrich_name, sum(mean) / 1000 AS wis, avg(std) / 500 AS relative_wis FROM eruns GROUP BY ALL)"


def board17(spark, d):
    name = F.concat(F.lit("i"), F.col("scenario_id").cast("string"), F.lit("::m_x::inpaint_CoPaint::celebahq_"), F.lower(F.expr("substr(config, 3)")))
    keys = [*ex.OPTIONS]
    return _essential_runs(spark, d).groupBy("scenario_id", name.alias("model"), *keys).agg((F.sum("mean") / 1000).alias("wis"), (F.avg("std") / 500).alias("relative_wis"))


@query("J14_attach_scenario", f"WITH {BOARD17} SELECT model, scenario_id, transform_name, enrich_name, round(wis, 3) AS wis FROM b17")
def _(spark, d):
    b = board17(spark, d).select("model", "wis")
    return ex.attach_scenario(b, ex.scenario_grid(spark)).select("model", "scenario_id", "transform_name", "enrich_name", F.round("wis", 3).alias("wis"))


@query("J17_loss_vs_score", f"WITH {BOARD17}, l AS (SELECT scenario_id, round(avg(final_loss), 3) AS loss FROM eruns GROUP BY ALL) SELECT b.model, l.loss, round(b.wis, 3) AS wis, round(relative_wis, 4) AS relative_wis FROM b17 b JOIN l ON l.scenario_id = b.scenario_id")
def _(spark, d):
    l = _essential_runs(spark, d).groupBy("scenario_id").agg(F.round(F.avg("final_loss"), 3).alias("loss"))  # noqa: E741
    return ex.loss_vs_score(l, board17(spark, d)).select("model", "loss", F.round("wis", 3).alias("wis"), F.round("relative_wis", 4).alias("relative_wis"))


@query("A19_run_summary_stats", f"WITH {RUNS} SELECT count(*) AS n_runs, count(DISTINCT scenario_id) AS n_scenarios, count(DISTINCT date) AS n_dates, count(DISTINCT config) AS n_configs, min(date) AS first_date, max(date) AS last_date, round(avg(completed), 4) AS completion_rate, round(avg(mean), 3) AS mean, round(avg(std), 3) AS std FROM runs")
def _(spark, d):
    out = ex.run_summary_stats(runs(spark, d))
    return out.withColumns({"completion_rate": F.round("completion_rate", 4), "mean": F.round("mean", 3), "std": F.round("std", 3)})


@query("A20_scenario_config_summary", f"WITH {RUNS} SELECT scenario_id, config, count(*) AS n, round(avg(mean), 3) AS mean, round(stddev_samp(mean), 3) AS mean_std, round(avg(std), 3) AS std, count(DISTINCT date) AS n_dates FROM runs GROUP BY ALL")
def _(spark, d):
    out = ex.scenario_config_summary(runs(spark, d))
    return out.withColumns({c: F.round(c, 3) for c in ("mean", "mean_std", "std")})


_KEYED = "r1 AS (SELECT scenario_id, date, config, avg(mean) AS mean, avg(std) AS std, min(num_samples) AS num_samples FROM runs GROUP BY ALL)"


def _keyed(spark, d):
    return runs(spark, d).groupBy("scenario_id", "date", "config").agg(F.avg("mean").alias("mean"), F.avg("std").alias("std"), F.min("num_samples").alias("num_samples"))


@query("A21_ensemble_mean", f"WITH {RUNS}, {_KEYED} SELECT scenario_id, date, round(avg(mean), 3) AS mean, round(avg(std), 3) AS std, arg_min(num_samples, config) AS num_samples, 'ensemble' AS config FROM r1 GROUP BY scenario_id, date")
def _(spark, d):
    return ex.ensemble_mean(_keyed(spark, d)).withColumns({c: F.round(c, 3) for c in ("mean", "std")})


@query("A22_daily_timeline", f"WITH {RUNS} SELECT config, date, round(avg(mean), 3) AS mean FROM runs GROUP BY ALL")
def _(spark, d):
    return ex.daily_timeline(runs(spark, d)).withColumn("mean", F.round("mean", 3))


@query("V04_run_heatmap", f"""WITH {RUNS} SELECT scenario_id, round(avg(CASE WHEN config = '1-URGENT' THEN mean END), 3) AS "1-URGENT", round(avg(CASE WHEN config = '5-LOW' THEN mean END), 3) AS "5-LOW" FROM runs GROUP BY ALL""")
def _(spark, d):
    return ex.run_heatmap(runs(spark, d), ["1-URGENT", "5-LOW"]).withColumns({c: F.round(F.col(f"`{c}`"), 3) for c in ("1-URGENT", "5-LOW")})


_EFF = " UNION ALL ".join(f"SELECT '{c}' AS parameter, {c} AS setting, model, wis, relative_wis FROM b17 WHERE ({_CHANGED}) - CASE WHEN {c} <> '{v}' THEN 1 ELSE 0 END = 0" for c, v in ex.BASELINE.items())


@query("A24_parameter_effects", f"WITH {BOARD17}, e AS ({_EFF}), base AS (SELECT min(wis) AS base FROM b17 WHERE {_CHANGED} = 0) SELECT parameter, setting, round(min(wis), 3) AS best_wis, round(min(relative_wis), 4) AS best_relative_wis, count(DISTINCT model) AS n_models, round((max(base) - min(wis)) / max(base) * 100, 2) AS improvement FROM e, base GROUP BY parameter, setting")
def _(spark, d):
    out = ex.parameter_effects(board17(spark, d))
    return out.withColumns({"best_wis": F.round("best_wis", 3), "best_relative_wis": F.round("best_relative_wis", 4)})


@query("A25_config_effects", rf"WITH {BOARD17} SELECT regexp_replace(regexp_extract(model, '::inpaint_CoPaint::(\w+)', 1), 'celebahq_', '') AS config, round(min(wis), 3) AS best_wis, round(min(relative_wis), 4) AS best_relative_wis, count(DISTINCT model) AS n_models FROM b17 GROUP BY 1")
def _(spark, d):
    return ex.config_effects(board17(spark, d)).withColumns({"best_wis": F.round("best_wis", 3), "best_relative_wis": F.round("best_relative_wis", 4)})


@query("A26_loss_score_correlation", f"WITH {BOARD17}, l AS (SELECT scenario_id, avg(final_loss) AS f, avg(std) AS m FROM eruns GROUP BY ALL), j AS (SELECT * FROM b17 JOIN l USING (scenario_id)) SELECT round(corr(f, wis), 4) AS final_loss_wis, round(corr(f, relative_wis), 4) AS final_loss_relative_wis, round(corr(m, wis), 4) AS last_mean_wis, round(corr(m, relative_wis), 4) AS last_mean_relative_wis FROM j")
def _(spark, d):
    l = _essential_runs(spark, d).groupBy("scenario_id").agg(F.avg("final_loss").alias("final_loss"), F.avg("std").alias("last_mean"))  # noqa: E741
    return r6(ex.loss_score_correlation(ex.loss_vs_score(l, board17(spark, d))))


@query("A29_epoch_loss", f"WITH {STEPS} SELECT run_id, (step - 1) // 10 AS epoch, round(avg(loss), 6) AS loss FROM steps GROUP BY ALL")
def _(spark, d):
    return ex.epoch_loss(steps(spark, d), 10).withColumn("loss", F.round("loss", 6))


@query("A30_steps_per_run", f"WITH {STEPS}, n AS (SELECT run_id, count(*) AS n FROM steps GROUP BY ALL) SELECT min(n) AS least, max(n) AS most FROM n")
def _(spark, d):
    return ex.steps_per_run(steps(spark, d))


@query("A35_completed_runs", f"WITH {RUNS} SELECT scenario_id, run_id, final_loss FROM runs WHERE completed = 1 AND final_loss IS NOT NULL")
def _(spark, d):
    return ex.completed_runs(runs(spark, d)).select("scenario_id", "run_id", "final_loss")


@query("W06_last_n_mean", f"WITH {STEPS}, l AS (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY step DESC) <= 15) SELECT run_id, round(avg(loss), 4) AS last_mean, arg_max(loss, step) AS final_loss FROM l GROUP BY run_id")
def _(spark, d):
    return r6(ex.last_n_mean(steps(spark, d), 15))


@query("W16_latest_finished_run", f"WITH {RUNS} SELECT scenario_id, run_id FROM runs WHERE status = 'FINISHED' QUALIFY row_number() OVER (PARTITION BY scenario_id ORDER BY start_time DESC, run_id DESC) = 1")
def _(spark, d):
    return ex.latest_finished_run(runs(spark, d))


# names

_FOLDERS = "fol AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'broken' ELSE 'i' || o_custkey || '::m_U500cRx124::ds_30S70M::conf_' || lower(substr(o_orderpriority, 1, 1)) || 'q::' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS folder, o_orderkey FROM orders)"


def _folders(spark, d):
    o = read(spark, d, "orders")
    name = F.concat(F.lit("i"), F.col("o_custkey").cast("string"), F.lit("::m_U500cRx124::ds_30S70M::conf_"), F.lower(F.substring("o_orderpriority", 1, 1)), F.lit("q::"), F.to_date("o_orderdate").cast("string"))
    return o.select(F.when(F.col("o_orderkey") % 9 == 0, "broken").otherwise(name).alias("folder"), "o_orderkey")


@query("X01_parse_run_folder", f"WITH {_FOLDERS}, p AS (SELECT o_orderkey, string_split(folder, '::') AS s FROM fol) SELECT o_orderkey, TRY_CAST(substr(s[1], 2) AS INTEGER) AS scenario_id, s[2] AS model_part, regexp_replace(CASE WHEN len(s) >= 2 THEN s[len(s) - 1] END, '^conf_', '') AS config, TRY_CAST(s[len(s)] AS DATE) AS date FROM p")
def _(spark, d):
    return _folders(spark, d).select("o_orderkey", *[c.alias(k) for k, c in nm.parse_run_folder(F.col("folder")).items()])


@query("X02_model_prefix", f"WITH {_FOLDERS}, p AS (SELECT o_orderkey, string_split(folder, '::') AS s FROM fol) SELECT o_orderkey, coalesce(array_to_string(s[1:len(s) - 1], '_'), '') AS prefix FROM p")
def _(spark, d):
    return _folders(spark, d).select("o_orderkey", nm.model_prefix(F.col("folder")).alias("prefix"))


@query("X03_scenario_id_of_model", rf"WITH {_FOLDERS} SELECT o_orderkey, TRY_CAST(nullif(regexp_extract(folder, '^i(\d+)::', 1), '') AS INTEGER) AS scenario_id FROM fol")
def _(spark, d):
    return _folders(spark, d).select("o_orderkey", nm.scenario_id_of_model(F.col("folder")).alias("scenario_id"))


@query("X04_inpaint_config_of_model", rf"WITH {BOARD17} SELECT model, coalesce(nullif(regexp_replace(regexp_extract(model, '::inpaint_CoPaint::(\w+)', 1), 'celebahq_', ''), ''), 'unknown') AS config FROM b17")
def _(spark, d):
    return board17(spark, d).select("model", nm.inpaint_config_of_model(F.col("model")).alias("config"))


@query("X05_scenario_string", f"WITH {_ERUNS} SELECT DISTINCT 'i' || scenario_id || '::m_' || ddpm_name || unet_name || '::ds_' || dataset_name || '::tr_' || transform_name || '::ri_' || enrich_name AS scenario_string FROM eruns")
def _(spark, d):
    return _essential_runs(spark, d).select(nm.scenario_string().alias("scenario_string")).distinct()


@query("X07_quantile_label", f"WITH {HUB} SELECT DISTINCT output_type_id AS q, rtrim(printf('%.3f', output_type_id), '0') AS short, printf('%.3f', output_type_id) AS long FROM hub")
def _(spark, d):
    q = F.col("q")
    return hub(spark, d).select(F.col("output_type_id").alias("q")).distinct().select("q", nm.quantile_label(q).alias("short"), nm.quantile_label(q, False).alias("long"))


@query("X08_place_to_code", f"WITH {LOC} SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'US' ELSE lpad(CAST(c_nationkey AS VARCHAR), 2, '0') END AS location_code FROM customer")
def _(spark, d):
    k = F.col("c_custkey") % 3
    place = F.when(k == 0, "US").when(k == 1, F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).otherwise(F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")))
    return pk.place_to_code(read(spark, d, "customer").select("c_custkey", place.alias("place")), locations(spark, d)).select("c_custkey", "location_code")


# picks


@query("W11_every_kth_date", f"WITH {TRUTH}, x AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS r FROM (SELECT DISTINCT date FROM truth)) SELECT date FROM x WHERE r % 7 = 0")
def _(spark, d):
    return pk.every_kth_date(truth(spark, d), "date", 7)


@query("W12_pick_spread", f"WITH {TRUTH}, x AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM truth WHERE date BETWEEN DATE '1996-08-01' AND DATE '1997-07-31')) SELECT date FROM x WHERE r % greatest(1, n // 6) = 0 AND r < 6 * greatest(1, n // 6)")
def _(spark, d):
    return pk.pick_spread(truth(spark, d), "date", 6, "1996-08-01", "1997-07-31")


@query("W13_even_samples", f"WITH {TRAJ} SELECT * FROM traj WHERE sample_id IN (0, 9, 19, 29, 39)")
def _(spark, d):
    return pk.even_samples(trajectories(spark, d), 40, 5)


@query("W14_best_row", f"WITH {SCORES}, m AS (SELECT model, sum(wis) AS score FROM scores GROUP BY ALL) SELECT model, round(score, 3) AS score FROM m ORDER BY score, model LIMIT 1")
def _(spark, d):
    m = scores(spark, d).groupBy("model").agg(F.sum("wis").alias("score"))
    return pk.best_row(m, "score", "model").withColumn("score", F.round("score", 3))


@query("W15_season_overlay", f"""WITH {OBS} SELECT season_week, sum(CASE WHEN fluseason = 1996 THEN value END) AS "1996", sum(CASE WHEN fluseason = 1997 THEN value END) AS "1997" FROM obs GROUP BY ALL""")
def _(spark, d):
    return tu.season_overlay(observations(spark, d), [1996, 1997])


_PLACES = ["0", "1", "2", "3"]


@query("V06_score_long", f"WITH {SCORES} " + " UNION ALL ".join(f"SELECT model, '{p}' AS location, round(sum(CASE WHEN location = '{p}' THEN wis END), 3) AS wis FROM scores GROUP BY model" for p in _PLACES))
def _(spark, d):
    wide = scores(spark, d).groupBy("model").pivot("location", _PLACES).agg(F.round(F.sum("wis"), 3))
    return wide.unpivot(["model"], _PLACES, "location", "wis")


# masks


_PAX = "pax AS (SELECT location_code, CAST(location_code AS INTEGER) - 1 AS place FROM (SELECT DISTINCT lpad(CAST(l_suppkey % 12 + 1 AS VARCHAR), 2, '0') AS location_code FROM lineitem)), cells AS (SELECT location_code, place, CAST(unnest(range(1, 54)) AS INTEGER) AS season_week FROM pax)"


def grid(spark, d):
    return mk.mask_grid(placed_axis(spark, d))


@query("K01_mask_dates", f"WITH {_PAX} SELECT location_code, season_week, CASE WHEN season_week BETWEEN 19 AND 23 OR season_week = 27 THEN 0 ELSE 1 END AS keep FROM cells")
def _(spark, d):
    return mk.mask_dates(grid(spark, d), [("2023-12-07", "2024-01-07"), "2024-02-01"]).drop("place")


@query("K02_mask_locations", f"WITH {_PAX} SELECT location_code, season_week, CASE WHEN location_code IN ('02', '05') THEN 0 ELSE 1 END AS keep FROM cells")
def _(spark, d):
    return mk.mask_locations(grid(spark, d), ["02", "05"]).drop("place")


@query("K03_mask_dates_for_locations", f"WITH {_PAX} SELECT location_code, season_week, CASE WHEN location_code IN ('02', '05') AND season_week BETWEEN 19 AND 23 THEN 0 ELSE 1 END AS keep FROM cells")
def _(spark, d):
    return mk.mask_dates_for_locations(grid(spark, d), [("2023-12-07", "2024-01-07")], ["02", "05"]).drop("place")


@query("K04_mask_checkerboard", f"WITH {_PAX} SELECT location_code, season_week, CASE WHEN ((season_week - 1) // 4 + place // 4) % 2 = 0 THEN 0 ELSE 1 END AS keep FROM cells")
def _(spark, d):
    return mk.mask_checkerboard(grid(spark, d), 4, 4).drop("place")


def _hidden(a: int, b: int) -> str:
    return f"season_week BETWEEN {a} AND {b}"


_MID, _PEAK, _GAP, _SIXTH = _hidden(19, 23), _hidden(27, 29), _hidden(19, 29), "location_code IN ('06', '37', '15', '42', '53')"
_MASKS = {
    "missing_midseason": _MID, "missing_midseason_peak": _PEAK, "missing_midseason_biggap": None, "missing_past": None, "missing_half_subpop": "place < half",
    "missing_nc": "location_code = '37'", "missing_ca": "location_code = '06'", "missing_il": "location_code = '17'", "missing_five": _SIXTH, "missing_five2": "location_code IN ('13', '49', '18', '36', '24')",
    "missing_midseason_biggap_halfpop": None, "missing_midseason_doublegap": f"{_MID} OR {_PEAK}", "missing_five_after_dec07": f"{_SIXTH} AND {_hidden(19, 52)}",
    "missing_checkerboard_4x4": "((season_week - 1) // 4 + place // 4) % 2 = 0", "missing_checkerboard_2x2": "((season_week - 1) // 2 + place // 2) % 2 = 0", "missing_first_half_selected": f"{_SIXTH} AND season_week <= 26",
}


def _week(day: str) -> str:
    return week_sql(f"DATE '{day}'")


_MASKS |= {
    "missing_midseason_biggap": f"season_week BETWEEN {_week('2024-12-07')} AND {_week('2024-02-15')}",
    "missing_past": f"season_week BETWEEN {_week('2024-08-01')} AND {_week('2024-01-07')}",
    "missing_midseason_biggap_halfpop": f"season_week BETWEEN {_week('2024-12-07')} AND {_week('2024-02-15')} OR place < half",
}


@query("K05_named_masks", f"WITH {_PAX}, h AS (SELECT count(*) // 2 AS half FROM pax), g AS (SELECT cells.*, half FROM cells, h) " + " UNION ALL ".join(f"SELECT '{k}' AS mask, season_week, location_code, CASE WHEN {v} THEN 0 ELSE 1 END AS keep FROM g" for k, v in _MASKS.items()))
def _(spark, d):
    return mk.named_masks(grid(spark, d), 2023)


@query("K06_masked_quantiles", f"WITH {OBS}, q AS (SELECT location_code, season_week, unnest({QS}) AS quantile, unnest(quantile_cont(value, {QS})) AS value FROM obs WHERE location_code IN ('02', '05') AND season_week BETWEEN 19 AND 23 GROUP BY location_code, season_week) SELECT location_code, season_week, round(quantile, 4) AS quantile, round(value, 4) AS value FROM q")
def _(spark, d):
    m = mk.mask_dates_for_locations(grid(spark, d), [("2023-12-07", "2024-01-07")], ["02", "05"])
    return r6(mk.masked_quantiles(observations(spark, d), m, ["location_code", "season_week"]))


@query("H08_keep_mask_from_date", f"WITH {TRUTH}, l AS (SELECT max(date) AS z FROM truth) SELECT location, date, CASE WHEN date < DATE '1997-02-01' THEN 1 ELSE 0 END AS keep, CASE WHEN date < z + 2 THEN 1 ELSE 0 END AS keep_late FROM truth, l")
def _(spark, d):
    t = truth(spark, d).select("location", "date")
    return tu.keep_mask_from_date(tu.keep_mask_from_date(t, "2030-01-01").withColumnRenamed("keep", "keep_late"), "1997-02-01")


