"""Queries: quantiles, hub tables, scores and leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecasts as fc
from ..operators import hub as hb
from ..operators import leaderboard as lb
from ..operators import scoring as sc
from .bindings import BASELINE, HUB, JOINED, QS, SAMPLES, SCORES, TRAJ, TRUTH, UNIT_SQL, hub, joined, query, r6, read, samples, scores, trajectories, truth


def _rounded(cols: str, names: list[str]) -> str:
    return cols + ", " + ", ".join(f"round({n}, 4) + 0.0 AS {n}" for n in names)


BOARD = f"""{SCORES}, most AS (SELECT season, count(DISTINCT target_end_date) AS m FROM scores GROUP BY season),
have AS (SELECT model, season, count(DISTINCT target_end_date) AS n FROM scores GROUP BY ALL),
flags AS (SELECT a.model, most.season, coalesce(n >= m - 5, false) AS include FROM (SELECT DISTINCT model FROM scores) a CROSS JOIN most LEFT JOIN have ON have.model = a.model AND have.season = most.season),
inc AS (SELECT *, bool_and(include) OVER (PARTITION BY model) AS include_combined FROM flags),
lab AS (SELECT s.model, s.season, wis, relative_wis FROM scores s JOIN inc ON s.model = inc.model AND s.season = inc.season WHERE include
  UNION ALL SELECT s.model, 'Combined', wis, relative_wis FROM scores s JOIN inc ON s.model = inc.model AND s.season = inc.season WHERE include_combined),
agg AS (SELECT season, model, sum(wis) AS wis, avg(relative_wis) AS relative_wis FROM lab GROUP BY ALL),
long AS (SELECT season, model, 'wis' AS metric, wis AS score, 'sum' AS aggregation FROM agg UNION ALL SELECT season, model, 'relative_wis', relative_wis, 'mean' FROM agg WHERE relative_wis IS NOT NULL),
board AS (SELECT *, CAST(row_number() OVER (PARTITION BY season, metric ORDER BY score, model) AS INTEGER) AS rank FROM long)"""
BOARD_SQL = f"WITH {BOARD} SELECT season, metric, aggregation, model, round(score, 4) AS score, rank FROM board"


def flagship(spark, d):
    """Samples to quantiles, join with truth, scores, relative scores, leaderboard."""
    return r6(lb.leaderboard(scores(spark, d)).select("season", "metric", "aggregation", "model", "score", "rank"))


query("A23_leaderboard", BOARD_SQL)(flagship)

_N = ["wis", "dispersion", "overprediction", "underprediction"]


@query("A05_ensemble_quantiles", f"WITH {HUB} SELECT model, location, target_end_date, output_type_id AS quantile, round(value, 4) AS value FROM hub")
def _(spark, d):
    return r6(fc.ensemble_quantiles(samples(spark, d), ["model", "location", "target_end_date"]))


@query("A06_national_quantiles", f"""WITH {TRAJ}, n AS (SELECT run_id, date, sample_id, sum(value) AS value FROM traj GROUP BY ALL)
SELECT run_id, date, unnest({QS}) AS quantile, round(unnest(quantile_cont(value, {QS})), 4) AS value, 'US' AS location FROM n GROUP BY run_id, date""")
def _(spark, d):
    return r6(fc.national_quantiles(trajectories(spark, d), ["run_id", "date"]))


@query("A07_mean_heatmap", f"WITH {SAMPLES} SELECT location, target_end_date, round(avg(value), 4) AS value, round(quantile_cont(value, 0.5), 4) AS median FROM samples GROUP BY ALL")
def _(spark, d):
    k = ["location", "target_end_date"]
    s = samples(spark, d)
    return r6(fc.mean_heatmap(s, k).join(fc.mean_heatmap(s, k, "median").withColumnRenamed("value", "median"), k))


@query("A08_wis_score", f"WITH {SCORES} SELECT {_rounded(UNIT_SQL, _N)} FROM scores")
def _(spark, d):
    return r6(scores(spark, d).select(*sc.UNIT, *_N))


@query("A09_interval_coverage", f"""WITH {SCORES} SELECT model, "group", round(avg(interval_coverage_50), 4) AS interval_coverage_50, round(avg(interval_coverage_90), 4) AS interval_coverage_90 FROM scores GROUP BY ALL""")
def _(spark, d):
    return r6(scores(spark, d).groupBy("model", "group").agg(F.avg("interval_coverage_50").alias("interval_coverage_50"), F.avg("interval_coverage_90").alias("interval_coverage_90")))


@query("A10_ae_median_bias", f"WITH {SCORES} SELECT {_rounded(UNIT_SQL, ['ae_median', 'bias'])} FROM scores")
def _(spark, d):
    return r6(scores(spark, d).select(*sc.UNIT, "ae_median", "bias"))


_LOWS = "(0.01, 0.025, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45)"
_W = str(sum((0.01, 0.025, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45)))


@query("A11_wis_interval_normalized", f"""WITH {JOINED}, p AS (SELECT {UNIT_SQL}, sum(CASE WHEN quantile < 0.5 THEN -quantile * predicted WHEN quantile > 0.5 THEN (1 - quantile) * predicted ELSE 0 END) / {_W} AS sharpness,
sum(CASE WHEN quantile < 0.5 THEN greatest(predicted - observed, 0) ELSE 0 END) / {_W} AS lo, sum(CASE WHEN quantile > 0.5 THEN greatest(observed - predicted, 0) ELSE 0 END) / {_W} AS hi FROM joined GROUP BY ALL)
SELECT {UNIT_SQL}, round(sharpness + lo + hi, 4) + 0.0 AS total, round(sharpness, 4) + 0.0 AS sharpness, round(lo + hi, 4) AS calibration, round(lo, 4) AS calibration_lower, round(hi, 4) AS calibration_upper FROM p""")
def _(spark, d):
    return r6(sc.wis_interval_normalized(joined(spark, d)))


@query("A12_quantile_completeness", f"""WITH {HUB}, h AS (SELECT * FROM hub WHERE NOT (model = '5-LOW' AND horizon = 2 AND output_type_id = 0.01)),
k AS (SELECT model, reference_date FROM h GROUP BY ALL HAVING count(DISTINCT round(output_type_id, 6)) = 23)
SELECT h.model, h.reference_date, count(*) AS n FROM h JOIN k ON h.model = k.model AND h.reference_date = k.reference_date GROUP BY ALL""")
def _(spark, d):
    h = hub(spark, d).where(~((F.col("model") == "5-LOW") & (F.col("horizon") == 2) & (F.col("output_type_id") == 0.01)))
    return hb.quantile_completeness(h).groupBy("model", "reference_date").agg(F.count("*").alias("n"))


@query("A13_rankings", f"WITH {SCORES} SELECT model, round(sum(wis), 4) AS total, round(avg(wis), 4) AS mean, round(quantile_cont(wis, 0.5), 4) AS median FROM scores GROUP BY ALL")
def _(spark, d):
    s = scores(spark, d)
    parts = [lb.rankings(s, "wis", h).withColumnRenamed("score", n) for h, n in (("sum", "total"), ("mean", "mean"), ("median", "median"))]
    return r6(parts[0].join(parts[1], "model").join(parts[2], "model"))


@query("A14_component_summary", f"""WITH {SCORES} SELECT model, "group", round(sum(dispersion), 4) AS dispersion, round(sum(overprediction), 4) AS overprediction, round(sum(underprediction), 4) AS underprediction,
round(avg(interval_coverage_50), 4) AS interval_coverage_50, round(avg(interval_coverage_90), 4) AS interval_coverage_90, round(sum(dispersion + overprediction + underprediction), 4) AS total FROM scores GROUP BY ALL""")
def _(spark, d):
    return r6(lb.component_summary(scores(spark, d)))


@query("A15_sum_over_locations", f"""WITH {SCORES} SELECT model, "group", season, target_end_date, horizon, round(sum(wis), 4) AS wis FROM scores WHERE location IN ('0', '1', '2') GROUP BY ALL""")
def _(spark, d):
    t = truth(spark, d).select("location").distinct().where("location <> '3'")
    return r6(lb.sum_over_locations(scores(spark, d), t))


@query("A16_components_by_location", f"""WITH {SCORES}, b AS (SELECT model, "group", location, dispersion, overprediction, underprediction FROM scores UNION ALL SELECT model, "group", 'States_Sum', dispersion, overprediction, underprediction FROM scores),
g AS (SELECT model, "group", location, sum(dispersion) AS dispersion, sum(overprediction) AS overprediction, sum(underprediction) AS underprediction FROM b GROUP BY ALL)
SELECT model, "group", location, c AS component, round(v, 4) AS value FROM (SELECT model, "group", location, unnest(['dispersion', 'overprediction', 'underprediction']) AS c, unnest([dispersion, overprediction, underprediction]) AS v FROM g)""")
def _(spark, d):
    return r6(lb.components_by_location(scores(spark, d)))


@query("A17_missing_report", f"""WITH {SCORES}, m AS (SELECT DISTINCT o_orderpriority AS model FROM orders UNION SELECT 'absent'),
h AS (SELECT model, count(*) AS a, count(DISTINCT location) AS l, count(DISTINCT horizon) AS h, count(DISTINCT target_end_date) AS dd FROM scores GROUP BY model)
SELECT m.model, 6400 AS expected, coalesce(a, 0) AS actual, greatest(0, 6400 - coalesce(a, 0)) AS missing, greatest(0, 4 - coalesce(l, 0)) AS missing_locations, greatest(0, 4 - coalesce(h, 0)) AS missing_horizons, greatest(0, 400 - coalesce(dd, 0)) AS missing_dates,
round(100 * (1 - greatest(0, 6400 - coalesce(a, 0)) / 6400.0), 4) AS completion, (greatest(0, 6400 - coalesce(a, 0)) > 0 AND coalesce(a, 0) < 0.9 * 6400) AS critical FROM m LEFT JOIN h ON m.model = h.model""")
def _(spark, d):
    models = read(spark, d, "orders").select(F.col("o_orderpriority").alias("model")).distinct().union(spark.range(1).select(F.lit("absent")))
    return r6(lb.missing_report(scores(spark, d), models, 4, 4, 400))


@query("A18_model_inclusion", f"WITH {BOARD} SELECT model, season, include, include_combined FROM inc")
def _(spark, d):
    return lb.model_inclusion(scores(spark, d)).select("model", "season", "include", "include_combined")


@query("A31_overlap_report", f"""WITH {HUB}, {TRUTH}, l AS (SELECT DISTINCT CAST(target_end_date AS VARCHAR) AS v FROM hub WHERE horizon < 2), r AS (SELECT DISTINCT CAST(date AS VARCHAR) AS v FROM truth),
l2 AS (SELECT DISTINCT location AS v FROM hub WHERE horizon < 2), r2 AS (SELECT DISTINCT location AS v FROM truth)
SELECT 'target_end_date' AS dimension, (SELECT count(*) FROM l WHERE v NOT IN (SELECT v FROM r)) AS left_only, (SELECT count(*) FROM l JOIN r USING (v)) AS both, (SELECT count(*) FROM r WHERE v NOT IN (SELECT v FROM l)) AS right_only
UNION ALL SELECT 'location', (SELECT count(*) FROM l2 WHERE v NOT IN (SELECT v FROM r2)), (SELECT count(*) FROM l2 JOIN r2 USING (v)), (SELECT count(*) FROM r2 WHERE v NOT IN (SELECT v FROM l2))""")
def _(spark, d):
    return hb.overlap_report(hub(spark, d).where("horizon < 2"), truth(spark, d).withColumnRenamed("date", "target_end_date"), ("target_end_date", "location"))


@query("A34_component_share", f"WITH {SCORES} SELECT target_end_date, horizon, round(sum(dispersion) / sum(dispersion + overprediction + underprediction), 4) + 0.0 AS sharpness_share, round(sum(overprediction) / sum(dispersion + overprediction + underprediction), 4) AS over_share FROM scores GROUP BY ALL")
def _(spark, d):
    return r6(sc.component_share(scores(spark, d)))


@query("J04_score_input_join", f"WITH {JOINED} SELECT {UNIT_SQL}, quantile, round(predicted, 4) AS predicted, observed FROM joined")
def _(spark, d):
    return r6(joined(spark, d).select(*sc.UNIT, "quantile", "predicted", "observed"))


@query("J04_lost_rows", f"WITH {HUB}, {TRUTH} SELECT model, count(*) AS n_lost FROM hub WHERE NOT EXISTS (SELECT 1 FROM truth WHERE date = target_end_date AND truth.location = hub.location AND truth.location <> '3') GROUP BY model")
def _(spark, d):
    return hb.lost_rows(hub(spark, d), truth(spark, d).where("location <> '3'"))


@query("J05_relative_score", f"WITH {SCORES} SELECT {_rounded(UNIT_SQL, ['wis', 'relative_wis'])} FROM scores")
def _(spark, d):
    return r6(scores(spark, d).select(*sc.UNIT, "wis", "relative_wis"))


@query("J16_wide_leaderboard", f"WITH {SCORES} SELECT season, model, round(sum(wis), 4) AS wis, round(avg(relative_wis), 4) AS relative_wis FROM scores GROUP BY ALL")
def _(spark, d):
    return r6(lb.wide_leaderboard(scores(spark, d)))


@query("J19_filter_to_top", f"""WITH {SCORES}, t AS (SELECT model FROM scores GROUP BY model ORDER BY sum(wis), model LIMIT 2) SELECT {_rounded(UNIT_SQL, ['wis'])} FROM scores WHERE model IN (SELECT model FROM t)""")
def _(spark, d):
    s = scores(spark, d)
    return r6(lb.filter_to(s, lb.rankings(s).orderBy("score", "model").limit(2)).select(*sc.UNIT, "wis"))


_PAIRS = " UNION ALL ".join(f"SELECT model, location, target_end_date, {lo} AS lower_q, max(CASE WHEN round(output_type_id, 6) = {lo} THEN value END) AS lower, max(CASE WHEN round(output_type_id, 6) = {hi} THEN value END) AS upper FROM hub GROUP BY ALL" for lo, hi in fc.PAIRS)


@query("J20_pair_quantiles", f"WITH {HUB} SELECT model, location, target_end_date, CAST(lower_q AS DOUBLE) AS lower_q, round(lower, 4) AS lower, round(upper, 4) AS upper FROM ({_PAIRS})")
def _(spark, d):
    return r6(fc.pair_quantiles(hub(spark, d), ["model", "location", "target_end_date"]))


@query("H04_quantile_fans", f"""WITH {HUB}, p AS ({_PAIRS}) SELECT p.model, p.location, p.target_end_date, CAST(lower_q AS DOUBLE) AS lower_q, round(lower, 4) AS lower, round(upper, 4) AS upper, round(m.value, 4) AS median, p.target_end_date > DATE '1998-01-03' AS future
FROM p JOIN hub m ON p.model = m.model AND p.location = m.location AND p.target_end_date = m.target_end_date AND round(m.output_type_id, 6) = 0.5""")
def _(spark, d):
    return r6(fc.quantile_fans(hub(spark, d), ["model", "location"], "target_end_date", "1998-01-03"))


@query("P03_filter_quantile_rows", f"WITH {HUB} SELECT model, location, target_end_date, horizon, output_type_id, round(value, 4) AS value FROM hub WHERE horizon IN (0, 1)")
def _(spark, d):
    text = hub(spark, d).withColumns({"output_type_id": F.col("output_type_id").cast("string"), "value": F.col("value").cast("string")})
    return r6(hb.filter_quantile_rows(text, horizons=(0, 1)).select("model", "location", "target_end_date", "horizon", "output_type_id", "value"))


@query("P13_exclude_models", f"WITH {SCORES} SELECT model, count(*) AS n FROM scores WHERE model NOT LIKE '1%' AND model <> '5-LOW' AND model NOT LIKE '%NOT%' GROUP BY ALL")
def _(spark, d):
    return lb.exclude_models(scores(spark, d), ("1",), ("5-LOW",), ("NOT",)).groupBy("model").agg(F.count("*").alias("n"))


@query("P14_exclude_outliers", f"WITH {SCORES} SELECT model, count(*) AS n FROM scores WHERE relative_wis <= 1.5 GROUP BY ALL")
def _(spark, d):
    return lb.exclude_outliers(scores(spark, d)).groupBy("model").agg(F.count("*").alias("n"))


@query("P16_drop_null_truth", f"WITH {HUB}, {TRUTH} SELECT model, count(*) AS n FROM hub JOIN truth ON date = target_end_date AND truth.location = hub.location WHERE truth.location <> '2' GROUP BY ALL")
def _(spark, d):
    t = truth(spark, d).where("location <> '2'")
    left = hub(spark, d).join(t.select(F.col("date").alias("target_end_date"), "location", F.col("value").alias("observed")), ["target_end_date", "location"], "left")
    return hb.drop_null_truth(left).groupBy("model").agg(F.count("*").alias("n"))


@query("S03_normalize_hub_columns", f"""WITH {HUB} SELECT model, reference_date, coalesce(t, 'wk inc flu hosp') AS target, output_type, output_type_id, round(value, 4) AS value, location, target_end_date FROM (
SELECT *, CASE WHEN horizon = 0 THEN NULL ELSE '1 wk ahead' END AS t FROM hub WHERE "group" = 'a') UNION ALL SELECT model, reference_date, target, output_type, output_type_id, round(value, 4), location, target_end_date FROM hub WHERE "group" = 'b'""")
def _(spark, d):
    cols = ["model", "reference_date", "target", "output_type", "output_type_id", "value", "location", "target_end_date"]
    h = hub(spark, d)
    old = h.where("group = 'a'").withColumn("target", F.when(F.col("horizon") != 0, "1 wk ahead")).select(*cols).withColumnsRenamed({"output_type": "type", "output_type_id": "quantile", "reference_date": "forecast_date"})
    return r6(hb.union_hubs(old, h.where("group = 'b'").select(*cols)).select(*cols))


@query("U03_missing_set", f"WITH {HUB} SELECT DISTINCT target_end_date FROM hub WHERE target_end_date NOT IN (SELECT target_end_date FROM hub WHERE model = '1-URGENT' AND location = '0')")
def _(spark, d):
    h = hub(spark, d)
    return hb.missing_set(h, h.where("model = '1-URGENT' AND location = '0'"), ["target_end_date"])


@query("U04_common_set", f"WITH {HUB} SELECT DISTINCT location, target_end_date FROM hub WHERE model = '1-URGENT' INTERSECT SELECT location, target_end_date FROM hub WHERE model = '5-LOW'")
def _(spark, d):
    h = hub(spark, d)
    return hb.common_set(h.where("model = '1-URGENT'"), h.where("model = '5-LOW'"), ["location", "target_end_date"])


@query("W02_cumulative_score", f"""WITH {SCORES}, x AS (SELECT model, "group", target_end_date, sum(wis) AS wis FROM scores GROUP BY ALL)
SELECT model, "group", target_end_date, round(wis, 4) AS wis, round(sum(wis) OVER (PARTITION BY model, "group" ORDER BY target_end_date ROWS UNBOUNDED PRECEDING), 3) AS cumulative_wis FROM x""")
def _(spark, d):
    return r6(lb.cumulative_score(scores(spark, d)).withColumn("cumulative_wis", F.round("cumulative_wis", 3)))


@query("W03_leaderboard_rank", f"WITH {BOARD} SELECT season, metric, model, rank FROM board")
def _(spark, d):
    return lb.leaderboard(scores(spark, d)).select("season", "metric", "model", "rank")


AVG_RANK = """piv AS (SELECT season, model, wis, relative_wis FROM agg), rk AS (SELECT season, model,
rank() OVER (PARTITION BY season ORDER BY wis NULLS FIRST) + (count(*) OVER (PARTITION BY season, wis) - 1) / 2.0 AS rk_wis, rank() OVER (PARTITION BY season ORDER BY relative_wis NULLS FIRST) + (count(*) OVER (PARTITION BY season, relative_wis) - 1) / 2.0 AS rk_relative_wis FROM piv)"""


@query("W04_average_rank", f"WITH {BOARD}, {AVG_RANK} SELECT season, model, CAST(rk_wis AS DOUBLE) AS rk_wis, CAST(rk_relative_wis AS DOUBLE) AS rk_relative_wis, CAST(rk_wis + rk_relative_wis AS DOUBLE) AS sum_rank FROM rk")
def _(spark, d):
    return lb.average_rank(lb.leaderboard_pivot(lb.leaderboard(scores(spark, d)))).select("season", "model", "rk_wis", "rk_relative_wis", "sum_rank")


@query("W05_season_rank_wide", f"""WITH {BOARD}, {AVG_RANK} SELECT model, CAST(max(CASE WHEN season = '1996' THEN rk_wis + rk_relative_wis END) AS DOUBLE) AS "1996", CAST(max(CASE WHEN season = '1997' THEN rk_wis + rk_relative_wis END) AS DOUBLE) AS "1997",
CAST(coalesce(max(CASE WHEN season = '1996' THEN rk_wis + rk_relative_wis END), 0) + coalesce(max(CASE WHEN season = '1997' THEN rk_wis + rk_relative_wis END), 0) AS DOUBLE) AS total_rank FROM rk GROUP BY model""")
def _(spark, d):
    return lb.season_rank_wide(lb.average_rank(lb.leaderboard_pivot(lb.leaderboard(scores(spark, d)))), ["1996", "1997"])


@query("W07_quantile_monotone_check", f"""WITH {HUB}, x AS (SELECT *, value < lag(value, 1, 0.0) OVER (PARTITION BY model, location, target_end_date ORDER BY output_type_id) AS f FROM (SELECT model, location, target_end_date, output_type_id, CASE WHEN output_type_id = 0.5 AND horizon = 1 THEN 0.0 ELSE value END AS value FROM hub))
SELECT model, location, target_end_date, count(*) AS n_falls FROM x WHERE f GROUP BY ALL""")
def _(spark, d):
    bent = hub(spark, d).withColumn("value", F.when((F.col("output_type_id") == 0.5) & (F.col("horizon") == 1), 0.0).otherwise(F.col("value")))
    return fc.monotone_violations(bent, ["model", "location", "target_end_date"])


def _top(metric: str, by: str, n: int, key: str) -> str:
    return f"""(SELECT {key}, model, avg({metric}) AS value, CAST(row_number() OVER (PARTITION BY {key} ORDER BY {by}, model) AS INTEGER) AS rank FROM scores GROUP BY {key}, model QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {by}, model) <= {n})"""


@query("W08_top_n_per_group", f"""WITH {SCORES} SELECT "group", model, round(value, 4) AS value, rank FROM {_top('relative_wis', 'abs(avg(relative_wis) - 1)', 1, '"group"')}""")
def _(spark, d):
    return r6(lb.top_n_per_group(scores(spark, d), 1, "relative_wis").select("group", "model", "value", "rank"))


@query("W09_top_n_per_facet", f"WITH {SCORES} SELECT DISTINCT model FROM {_top('wis', 'avg(wis)', 2, 'horizon')}")
def _(spark, d):
    return lb.top_n_per_facet(scores(spark, d), 2, "horizon")


@query("W10_top5_any_season", f"WITH {SCORES} SELECT model FROM {_top('wis', 'avg(wis)', 1, 'season')} UNION SELECT model FROM {_top('relative_wis', 'abs(avg(relative_wis) - 1)', 1, 'season')}")
def _(spark, d):
    return lb.top5_any_season(scores(spark, d), 1)


@query("V01_score_heatmap", f"""WITH {SCORES}, c AS (SELECT model, target_end_date, horizon, avg(wis) AS wis FROM scores GROUP BY ALL), o AS (SELECT model, avg(wis) AS row_score, CAST(row_number() OVER (ORDER BY avg(wis), model) AS INTEGER) AS row_order FROM c GROUP BY model)
SELECT c.model, target_end_date, horizon, round(wis, 4) AS wis, round(row_score, 4) AS row_score, row_order FROM c JOIN o ON c.model = o.model""")
def _(spark, d):
    return r6(lb.score_heatmap(scores(spark, d)))


@query("V02_leaderboard_pivot", f"WITH {BOARD} SELECT season, model, round(wis, 4) AS wis, round(relative_wis, 4) AS relative_wis FROM agg")
def _(spark, d):
    return r6(lb.leaderboard_pivot(lb.leaderboard(scores(spark, d))))


@query("V05_score_components_wide", f"WITH {SCORES} SELECT model, round(sum(dispersion), 4) AS dispersion, round(sum(overprediction), 4) AS overprediction, round(sum(underprediction), 4) AS underprediction FROM scores GROUP BY ALL")
def _(spark, d):
    return r6(lb.score_components_wide(scores(spark, d)))


@query("H03_validate_forecast", f"""WITH {HUB}, x AS (SELECT *, value < lag(value, 1, 0.0) OVER (PARTITION BY model, location, target_end_date ORDER BY output_type_id) AS f FROM hub)
SELECT count(CASE WHEN value < 0 THEN 1 END) AS n_negative, count(CASE WHEN value IS NULL THEN 1 END) AS n_null, count(CASE WHEN f THEN 1 END) AS n_falls FROM x""")
def _(spark, d):
    return fc.validate_forecast(hub(spark, d), ["model", "location", "target_end_date"])


@query("H07_national_trajectories", f"WITH {TRAJ} SELECT run_id, date, sample_id, sum(value) AS value FROM traj GROUP BY ALL")
def _(spark, d):
    return fc.national_samples(trajectories(spark, d), ["run_id", "date", "sample_id"])


@query("A28_national_forecast_stats", f"WITH {TRAJ}, n AS (SELECT run_id, date, sample_id, sum(value) AS value FROM traj GROUP BY ALL) SELECT run_id, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, min(value) AS least, max(value) AS most, count(*) AS n FROM n GROUP BY run_id")
def _(spark, d):
    return r6(fc.national_forecast_stats(trajectories(spark, d)))


@query("A36_sample_value_range", f"WITH {TRAJ} SELECT min(value) AS least, max(value) AS most FROM traj WHERE sample_id IN (1, 5, 9)")
def _(spark, d):
    return fc.sample_value_range(trajectories(spark, d), [1, 5, 9])


@query("A37_mean_national_curve", f"WITH {TRAJ}, n AS (SELECT run_id, date, sample_id, sum(value) AS value FROM traj WHERE sample_id IN (1, 5, 9) GROUP BY ALL) SELECT run_id, date, round(avg(value), 4) AS value FROM n GROUP BY ALL")
def _(spark, d):
    return r6(fc.mean_national_curve(trajectories(spark, d), ["run_id", "date"], [1, 5, 9]))


@query("H05_prune_trends", f"""WITH {TRAJ}, n AS (SELECT run_id, sample_id, sum(CASE WHEN date = DATE '1997-01-04' THEN value END) AS a, sum(CASE WHEN date = DATE '1997-02-01' THEN value END) AS b FROM traj GROUP BY ALL)
SELECT run_id, sample_id FROM n WHERE b <= 2 * a AND b >= 0.7 * a""")
def _(spark, d):
    t = trajectories(spark, d)
    return fc.prune_trends(fc.national_samples(t, ["run_id", "date", "sample_id"]), ["run_id"], "date", "1997-01-04", "1997-02-01")


_NOISE = "(sqrt(-2 * ln(greatest((('0x' || substr(md5('rescalea|' || t.sample_id || '|' || t.location), 1, 8))::BIGINT / 4294967296.0), 1e-12))) * cos(2 * pi() * (('0x' || substr(md5('rescaleb|' || t.sample_id || '|' || t.location), 1, 8))::BIGINT / 4294967296.0)))"


@query("H06_rescale_to_last_obs", f"""WITH {TRAJ}, l AS (SELECT location, arg_max(value, (date, value)) AS o FROM (SELECT location, date, sum(value) AS value FROM traj GROUP BY ALL) GROUP BY location), st AS (SELECT location, sample_id, arg_min(value, (date, value)) AS s FROM (SELECT location, sample_id, date, sum(value) AS value FROM traj GROUP BY ALL) GROUP BY ALL)
SELECT run_id, t.location, date, t.sample_id, round(CASE WHEN s > 0 THEN value * o / s * greatest(0.9, least(1.1, 1 + 0.05 * {_NOISE})) ELSE value END, 4) AS value FROM traj t JOIN l ON l.location = t.location JOIN st ON st.location = t.location AND st.sample_id = t.sample_id""")
def _(spark, d):
    """Samples scaled from their first week's sum to the last week's of their place."""
    t = trajectories(spark, d)
    by = lambda keys: t.groupBy(*keys, "date").agg(F.sum("value").alias("value"))
    last = by(["location"]).groupBy("location").agg(F.max_by("value", F.struct("date", "value")).alias("value"))
    start = by(["location", "sample_id"]).groupBy("location", "sample_id").agg(F.min_by("value", F.struct("date", "value")).alias("value"))
    return r6(fc.rescale_to_last_obs(t, last, start))


_WHOLE = f"""WITH {HUB}, n AS (SELECT model, target_end_date, sample_id, sum(value) AS value FROM samples GROUP BY ALL),
us AS (SELECT model, target_end_date, unnest({QS}) AS q, unnest(quantile_cont(value, {QS})) AS value FROM n GROUP BY model, target_end_date),
c AS (SELECT location, target_end_date, output_type_id AS q, value, CAST(((target_end_date - DATE '1995-01-07') // 7) % 4 AS INTEGER) AS h FROM hub
  UNION ALL SELECT 'US', target_end_date, q, value, CAST(((target_end_date - DATE '1995-01-07') // 7) % 4 AS INTEGER) FROM us),
f AS (SELECT *, CAST(target_end_date - 7 * h AS DATE) AS f FROM c)"""


def whole_hub(spark, d, reference):
    """Quantiles of all places and of their national sums, for each of the hub's own reference dates.

    Values are rounded to five places: quantiles of cents are multiples of 0.00005, so there are no ties.
    """
    own = hub(spark, d).select("target_end_date", "reference_date", "location", F.col("output_type_id").alias("quantile"), "value")
    us = fc.national_quantiles(samples(spark, d), ["model", "target_end_date"])
    us = us.join(own.select("target_end_date", "reference_date").distinct(), "target_end_date")
    return own.unionByName(us.select(*own.columns)).withColumnRenamed("reference_date", reference)


@query("H01_export_hub_2023", f"{_WHOLE} SELECT f AS reference_date, 'wk inc flu hosp' AS target, h AS horizon, target_end_date, location, 'quantile' AS output_type, rtrim(printf('%.3f', q), '0') AS output_type_id, round(value, 5) AS value FROM f")
def _(spark, d):
    return fc.export_hub_2023(whole_hub(spark, d, "reference_date")).withColumn("value", F.round("value", 5))


@query("H02_export_hub_2022", f"{_WHOLE} SELECT f AS forecast_date, target_end_date, location, 'quantile' AS type, printf('%.3f', q) AS quantile, round(value, 5) AS value, printf('%d wk ahead inc flu hosp', h + 1) AS target FROM f")
def _(spark, d):
    return fc.export_hub_2022(whole_hub(spark, d, "forecast_date")).withColumn("value", F.round("value", 5))
