"""Queries: seasons, draws, frames, tensors and transforms."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import draws as dr
from ..functions import names as nm
from ..functions import seasons as se
from ..operators import frames as fr
from ..operators import tensors as tn
from ..operators import transforms as tr
from ..sources.shared import written
from .bindings import OBS, observations, query, r6, read, season_sql, week_sql

_DAYS = "days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem)"


def days(spark, d):
    return read(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct()


@query("D01_season_week", f"WITH {_DAYS} SELECT d, {week_sql('d')} AS season_week FROM days")
def _(spark, d):
    return days(spark, d).withColumn("season_week", se.season_week(F.col("d")))


@query("D02_season_year", f"WITH {_DAYS} SELECT d, {season_sql('d')} AS season FROM days")
def _(spark, d):
    return days(spark, d).withColumn("season", se.season_year(F.col("d")))


@query("D03_season_fraction", f"WITH {_DAYS} SELECT d, round((d - make_date({season_sql('d')}, 8, 1)) / 365.0, 4) AS fraction FROM days")
def _(spark, d):
    return r6(days(spark, d).withColumn("fraction", se.season_fraction(F.col("d"))))


_SATD = "(d + CAST(6 - dayofweek(d) AS INTEGER))"
_EPI = f"CAST(({_SATD} - (make_date(CAST(year({_SATD} - 3) AS INTEGER), 1, 4) + CAST(6 - dayofweek(make_date(CAST(year({_SATD} - 3) AS INTEGER), 1, 4)) AS INTEGER))) // 7 + 1 AS INTEGER)"


@query("D04_add_season_columns", f"WITH {_DAYS} SELECT d, {season_sql('d')} AS fluseason, {week_sql('d')} AS season_week, round((d - make_date({season_sql('d')}, 8, 1)) / 365.0, 4) AS fluseason_fraction, {_EPI} AS epiweek FROM days")
def _(spark, d):
    return r6(se.add_season_columns(days(spark, d), "d", epiweek=True))


_SEASONS = f"seasons AS (SELECT DISTINCT {season_sql('CAST(l_shipdate AS DATE)')} AS season FROM lineitem)"
_CAL = f"""{_SEASONS}, w AS (SELECT season, unnest(range(1, 54)) AS week FROM seasons),
cal AS (SELECT season, CAST(week AS INTEGER) AS week, CAST(make_date(season, 8, 1) + CAST(7 * (week - 1) AS INTEGER) AS DATE) AS start_date FROM w WHERE make_date(season, 8, 1) + CAST(7 * (week - 1) AS INTEGER) < make_date(season + 1, 8, 1)),
calendar AS (SELECT season, week, start_date, start_date + 6 AS end_date, start_date + CAST(6 - dayofweek(start_date) AS INTEGER) AS saturday FROM cal)"""


def calendar(spark, d):
    return se.season_calendar(days(spark, d).select(se.season_year(F.col("d")).alias("season")).distinct())


@query("D05_week_dates", f"WITH {_CAL} SELECT season, week, start_date, end_date FROM calendar")
def _(spark, d):
    return calendar(spark, d).select("season", "week", se.week_start(F.col("season"), F.col("week")).alias("start_date"), se.week_end(F.col("season"), F.col("week")).alias("end_date"))


@query("D06_week_to_saturday", f"WITH {_CAL} SELECT season, week, saturday FROM calendar")
def _(spark, d):
    return calendar(spark, d).select("season", "week", se.week_saturday(F.col("season"), F.col("week")).alias("saturday"))


query("D07_season_calendar", f"WITH {_CAL} SELECT * FROM calendar")(calendar)


@query("D08_season_saturdays", f"WITH {_DAYS}, b AS (SELECT {season_sql('d')} AS season, min(d) AS a, max(d) AS z FROM days GROUP BY season) SELECT DISTINCT CAST(unnest(generate_series(CAST(a + CAST(6 - dayofweek(a) AS INTEGER) AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS saturday FROM b")
def _(spark, d):
    return se.season_saturdays(days(spark, d).groupBy(se.season_year(F.col("d"))).agg(F.min("d").alias("first"), F.max("d").alias("last")))


@query("D09_epiweek_to_enddate", f"WITH {_DAYS} SELECT DISTINCT CAST(year({_SATD} - 3) * 100 + {_EPI} AS INTEGER) AS epiweek, CAST({_SATD} AS DATE) AS end_date FROM days")
def _(spark, d):
    sat = se.saturday_of(F.col("d"))
    e = (F.year(F.date_sub(sat, 3)) * 100 + se.date_to_epiweek(F.col("d"))).cast("int")
    return days(spark, d).select(e.alias("epiweek")).distinct().withColumn("end_date", se.epiweek_to_enddate(F.col("epiweek")))


@query("D10_date_to_epiweek", f"WITH {_DAYS} SELECT d, {_EPI} AS epiweek FROM days")
def _(spark, d):
    return days(spark, d).withColumn("epiweek", se.date_to_epiweek(F.col("d")))


@query("D11_season_landmarks", f"WITH {_CAL}, l AS (SELECT season, list(saturday ORDER BY saturday) AS s FROM calendar GROUP BY season) SELECT season, s[1] AS first_saturday, s[greatest(0, len(s) // 2 - 1) + 1] AS mid_saturday, s[len(s)] AS last_saturday FROM l")
def _(spark, d):
    return se.season_landmarks(calendar(spark, d))


@query("D12_horizon_of", f"WITH {_DAYS} SELECT d, CAST(ceil((d - DATE '1997-01-04') / 7.0) AS INTEGER) AS horizon FROM days")
def _(spark, d):
    return days(spark, d).withColumn("horizon", se.horizon_of(F.lit("1997-01-02").cast("date"), F.col("d")))



# frames


def axis(spark, d):
    """The twelve places of the bound observations, in order."""
    return read(spark, d, "lineitem").select(F.lpad((F.col("l_suppkey") % 12 + 1).cast("string"), 2, "0").alias("location_code")).distinct()


AXIS = "axis AS (SELECT DISTINCT lpad(CAST(l_suppkey % 12 + 1 AS VARCHAR), 2, '0') AS location_code FROM lineitem)"
MIX = {"A": {"multiplier": 2}, "N": {"multiplier": 1}, "R": {"multiplier": 1}}
PROPORTIONS = {"A": {"proportion": 0.7, "total": 150}, "N": {"proportion": 0.3, "total": 150}}
FRAMES = f"""{OBS}, {AXIS}, keys AS (SELECT DISTINCT datasetH1, datasetH2, fluseason, sample FROM obs),
frames AS (SELECT *, datasetH1 || '/' || datasetH2 || '/' || fluseason || '/' || sample || CASE WHEN copy_num > 0 THEN '_copy' || copy_num ELSE '' END AS frame_id
  FROM (SELECT *, CAST(unnest(range(0, CASE WHEN datasetH1 = 'A' THEN 2 ELSE 1 END)) AS INTEGER) AS copy_num FROM keys)),
missing AS (SELECT f.*, a.location_code FROM frames f CROSS JOIN axis a WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.datasetH1 = f.datasetH1 AND o.datasetH2 = f.datasetH2 AND o.fluseason = f.fluseason AND o.sample = f.sample AND o.location_code = a.location_code))"""


def stored(spark, d):
    """The observations as a table of their own, as the operators that go over them many times find them."""
    return written(observations(spark, d))


def frames(spark, d, obs=None):
    obs = obs or observations(spark, d)
    return obs, fr.replicate_frames(fr.frame_keys(obs), fr.explicit_multipliers(fr.base_frame_counts(obs), MIX))


#: name, fill, and per source: multiplier, proportion, total, to_scale
MIXES = {
    "whole": ("random", {"A": {"multiplier": 2}, "N": {"multiplier": 1}, "R": {"multiplier": 1}}),
    "shares": ("zeros", {"A": {"proportion": 0.7, "total": 150}, "N": {"proportion": 0.3, "total": 150}}),
    "two_totals": ("zeros", {"A": {"proportion": 0.7, "total": 150}, "N": {"proportion": 0.3, "total": 90}}),
    "both_kinds": ("zeros", {"A": {"multiplier": 1}, "N": {"proportion": 1.0, "total": 2}}),
    "neither_kind": ("skip", {"A": {"total": 2}}),
    "unknown_source": ("zeros", {"Q": {"multiplier": 1}}),
    "unknown_fill": ("guess", {"A": {"multiplier": 2}}),
    "no_scaling": ("zeros", {"A": {"multiplier": 1, "to_scale": True}}),
}
_MIX_ROWS = ", ".join(f"('{k}', '{fill}', '{h1}', {c.get('multiplier', 'NULL')}, {c.get('proportion', 'NULL')}, {c.get('total', 'NULL')}, {c.get('to_scale', False)})" for k, (fill, mix) in MIXES.items() for h1, c in mix.items())


@query("F01_validate_mix", f"""WITH {OBS}, mix(name, fill, h1, m, p, total, scale) AS (VALUES {_MIX_ROWS}),
known AS (SELECT mix.*, h1 IN (SELECT datasetH1 FROM obs) AS there FROM mix)
SELECT name, max(fill) NOT IN ('error', 'zeros', 'random', 'skip') OR NOT bool_and(there) OR (count(p) > 0 AND count(m) > 0) OR (count(p) > 0 AND (count(p) < count(*) OR count(DISTINCT total) <> 1)) OR (count(p) = 0 AND count(m) < count(*)) OR bool_or(scale) AS refused
FROM known GROUP BY name""")
def _(spark, d):
    have = {r[0] for r in observations(spark, d).select("datasetH1").distinct().collect()}

    def refused(fill, mix):
        try:
            fr.check_mix(have, mix, fill)
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(k, refused(fill, mix)) for k, (fill, mix) in MIXES.items()], "name string, refused boolean")


@query("F02_base_frame_counts", f"WITH {OBS} SELECT datasetH1, count(*) AS base FROM (SELECT DISTINCT datasetH1, datasetH2, fluseason, sample FROM obs) GROUP BY datasetH1")
def _(spark, d):
    return fr.base_frame_counts(observations(spark, d))


@query("F03_proportional_multipliers", f"WITH {OBS}, b AS (SELECT datasetH1, count(*) AS base FROM (SELECT DISTINCT datasetH1, datasetH2, fluseason, sample FROM obs) GROUP BY datasetH1) SELECT datasetH1, CAST(greatest(1, round_even((CASE datasetH1 WHEN 'A' THEN 105 ELSE 45 END) / CAST(base AS DOUBLE), 0)) AS INTEGER) AS multiplier FROM b WHERE datasetH1 IN ('A', 'N')")
def _(spark, d):
    return fr.proportional_multipliers(fr.base_frame_counts(observations(spark, d)), PROPORTIONS)


@query("F04_explicit_multipliers", f"WITH {OBS} SELECT DISTINCT datasetH1, CASE datasetH1 WHEN 'A' THEN 2 ELSE 1 END AS multiplier FROM obs")
def _(spark, d):
    return fr.explicit_multipliers(fr.base_frame_counts(observations(spark, d)), MIX)


@query("F05_replicate_frames", f"WITH {FRAMES} SELECT datasetH1, datasetH2, fluseason, sample, copy_num, frame_id FROM frames")
def _(spark, d):
    return frames(spark, d)[1].drop("origin")


@query("F06_find_missing_locations", f"WITH {FRAMES} SELECT frame_id, location_code FROM missing")
def _(spark, d):
    obs, f = frames(spark, d)
    return fr.find_missing_locations(f, obs, axis(spark, d)).select("frame_id", "location_code")


@query("F07_fill_error", f"WITH {FRAMES} SELECT frame_id, string_agg(DISTINCT location_code, ',' ORDER BY location_code) AS places, count(DISTINCT location_code) AS n_missing FROM missing GROUP BY frame_id")
def _(spark, d):
    obs, f = frames(spark, d)
    return fr.missing_report(fr.find_missing_locations(f, obs, axis(spark, d)))


@query("F08_fill_skip", f"WITH {FRAMES} SELECT frame_id FROM frames WHERE frame_id NOT IN (SELECT frame_id FROM missing)")
def _(spark, d):
    obs, f = frames(spark, d)
    return fr.fill_skip(f, fr.find_missing_locations(f, obs, axis(spark, d))).select("frame_id")


ZEROS = """zeros AS (SELECT m.frame_id, m.location_code, CAST(unnest(range(1, 54)) AS INTEGER) AS season_week, 0.0::DOUBLE AS value, f.week_enddate, m.frame_id || '[filled_zeros]' AS origin FROM missing m
JOIN (SELECT datasetH1, datasetH2, fluseason, sample, min(week_enddate) AS week_enddate FROM obs GROUP BY ALL) f ON m.datasetH1 = f.datasetH1 AND m.datasetH2 = f.datasetH2 AND m.fluseason = f.fluseason AND m.sample = f.sample)"""


@query("F09_fill_zeros", f"WITH {FRAMES}, {ZEROS} SELECT * FROM zeros")
def _(spark, d):
    obs, f = frames(spark, d)
    return fr.fill_zeros(fr.find_missing_locations(f, obs, axis(spark, d)), obs)


@query("F10_fill_lookup", f"WITH {OBS}, x AS (SELECT location_code, datasetH1, fluseason, min(datasetH2 || '|' || sample) AS k FROM obs GROUP BY ALL) SELECT location_code, datasetH1, fluseason, split_part(k, '|', 1) AS datasetH2, split_part(k, '|', 2) AS sample FROM x")
def _(spark, d):
    return fr.fill_lookup(observations(spark, d))[0]


def _u(seed: str, keys: str) -> str:
    return f"(('0x' || substr(md5('{seed}|' || {keys}), 1, 8))::BIGINT / 4294967296.0)"


# candidates of each tier in order; of the best tier the one at a hashed position
DONORS = f"""yr AS (SELECT location_code, datasetH1, fluseason, split_part(min(datasetH2 || '|' || sample), '|', 1) AS datasetH2, split_part(min(datasetH2 || '|' || sample), '|', 2) AS sample FROM obs GROUP BY ALL),
sm AS (SELECT location_code, datasetH1, fluseason, sample, min(datasetH2) AS datasetH2 FROM obs GROUP BY ALL),
tiers AS (
  SELECT m.frame_id, m.location_code, 1 AS tier, c.datasetH1, c.datasetH2, c.fluseason, c.sample, 'filled_same_location_year_' || c.fluseason || '_sample_' || c.sample AS note, CAST(c.fluseason AS VARCHAR) AS o FROM missing m JOIN yr c ON m.location_code = c.location_code AND c.datasetH1 = m.datasetH1 AND c.fluseason <> m.fluseason
  UNION ALL SELECT m.frame_id, m.location_code, 2, c.datasetH1, c.datasetH2, c.fluseason, c.sample, 'filled_same_location_sample_' || c.sample, c.sample FROM missing m JOIN sm c ON m.location_code = c.location_code AND c.datasetH1 = m.datasetH1 AND c.fluseason = m.fluseason AND c.sample <> m.sample
  UNION ALL SELECT m.frame_id, m.location_code, 3, c.datasetH1, c.datasetH2, c.fluseason, c.sample, 'filled_same_location_' || c.datasetH1 || '_year_' || c.fluseason, CAST(c.fluseason AS VARCHAR) FROM missing m
    JOIN (SELECT m.frame_id, m.location_code, min(c.datasetH1) AS h1 FROM missing m JOIN yr c ON m.location_code = c.location_code AND c.datasetH1 <> m.datasetH1 GROUP BY ALL) z ON z.frame_id = m.frame_id AND z.location_code = m.location_code JOIN yr c ON m.location_code = c.location_code AND c.datasetH1 = z.h1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY frame_id, location_code, tier ORDER BY o) AS r, count(*) OVER (PARTITION BY frame_id, location_code, tier) AS n, min(tier) OVER (PARTITION BY frame_id, location_code) AS best FROM tiers),
donors AS (SELECT * FROM ranked WHERE tier = best AND r = 1 + CAST(floor({_u('0', "frame_id || '|' || location_code")} * n) AS INTEGER))"""


@query("F11_fill_random", f"WITH {FRAMES}, {DONORS} SELECT d.frame_id, d.location_code, o.season_week, o.value, o.week_enddate, d.frame_id || '[' || note || ']' AS origin FROM donors d JOIN obs o ON o.datasetH1 = d.datasetH1 AND o.datasetH2 = d.datasetH2 AND o.fluseason = d.fluseason AND o.sample = d.sample AND o.location_code = d.location_code")
def _(spark, d):
    obs, f = frames(spark, d, stored(spark, d))
    return fr.fill_random(fr.find_missing_locations(f, obs, axis(spark, d)), obs)


def _padded(rows: str) -> str:
    return f"""span AS (SELECT frame_id, location_code, min(season_week) AS lo, max(season_week) AS hi, arg_min(week_enddate, season_week) AS fd, arg_min(origin, season_week) AS fo FROM {rows} GROUP BY ALL),
grid AS (SELECT *, CAST(unnest(range(1, 54)) AS INTEGER) AS season_week FROM span),
fullgrid AS (SELECT g.frame_id, g.location_code, g.season_week, lo, hi, fd, fo, r.value AS v, r.week_enddate AS d, r.origin AS o FROM grid g LEFT JOIN {rows} r ON r.frame_id = g.frame_id AND r.location_code = g.location_code AND r.season_week = g.season_week),
padded AS (SELECT frame_id, location_code, season_week, CASE WHEN v IS NOT NULL THEN v WHEN season_week BETWEEN lo AND hi THEN coalesce(lag(v) OVER (PARTITION BY frame_id, location_code ORDER BY season_week), 0) ELSE 0 END AS value, coalesce(d, fd) AS week_enddate, coalesce(o, fo) AS origin FROM fullgrid)"""


_OWN = "own AS (SELECT f.frame_id, o.location_code, o.season_week, o.value, o.week_enddate, f.frame_id AS origin FROM frames f JOIN obs o ON o.datasetH1 = f.datasetH1 AND o.datasetH2 = f.datasetH2 AND o.fluseason = f.fluseason AND o.sample = f.sample)"
_BUILT = f"{FRAMES}, {_OWN}, {ZEROS}, rows0 AS (SELECT * FROM own UNION ALL SELECT * FROM zeros), {_padded('rows0')}"


@query("F12_pad_weeks", f"WITH {FRAMES}, {_OWN}, {_padded('own')} SELECT frame_id, location_code, season_week, value, week_enddate, origin FROM padded")
def _(spark, d):
    obs, f = frames(spark, d)
    own = f.join(obs.drop("fluseason_fraction"), fr.KEY).select("frame_id", "location_code", "season_week", "value", "week_enddate", "origin")
    return fr.pad_weeks(own, axis(spark, d))


query("W01_gap_fill", f"WITH {FRAMES}, {_OWN}, {_padded('own')} SELECT frame_id, sum(value) AS total, count(*) AS n FROM padded GROUP BY frame_id")(
    lambda spark, d: fr.pad_weeks(_own(spark, d), axis(spark, d)).groupBy("frame_id").agg(F.sum("value").alias("total"), F.count("*").alias("n"))
)


def _own(spark, d):
    obs, f = frames(spark, d)
    return f.join(obs.drop("fluseason_fraction"), fr.KEY).select("frame_id", "location_code", "season_week", "value", "week_enddate", "origin")


@query("F13_season_peak_scale", f"""WITH {FRAMES}, {_OWN}, t AS (SELECT list(peak ORDER BY peak) AS l FROM (SELECT max(v) AS peak FROM (SELECT datasetH2, fluseason, sample, sum(value) AS v FROM obs WHERE datasetH1 = 'R' GROUP BY datasetH2, fluseason, sample, season_week) GROUP BY datasetH2, fluseason, sample)),
p AS (SELECT frame_id, max(v) AS peak FROM (SELECT frame_id, season_week, sum(value) AS v FROM own GROUP BY ALL) GROUP BY frame_id),
dr AS (SELECT frame_id, peak, l[CAST(floor((('0x' || substr(md5('0|' || frame_id), 1, 8))::BIGINT / 4294967296.0) * len(l)) AS INTEGER) + 1] AS target FROM p, t)
SELECT o.frame_id, location_code, season_week, round(value * CASE WHEN peak > 0 THEN target / peak ELSE 1 END, 4) AS value, o.frame_id || '[scaled_to_' || printf('%.1f', target) || ']' AS origin FROM own o JOIN dr ON o.frame_id = dr.frame_id""")
def _(spark, d):
    out = fr.season_peak_scale(_own(spark, d), fr.scaling_distribution(observations(spark, d), "R"))
    return r6(out.drop("week_enddate"))


@query("F14_build_frames", f"WITH {_BUILT} SELECT frame_id, location_code, season_week, value, week_enddate, origin FROM padded")
def _(spark, d):
    return fr.build_frames(stored(spark, d), axis(spark, d), MIX, "zeros")


@query("F14_build_frames_random", f"""WITH {FRAMES}, {_OWN}, {DONORS}, fill AS (SELECT d.frame_id, d.location_code, o.season_week, o.value, o.week_enddate, d.frame_id || '[' || note || ']' AS origin FROM donors d JOIN obs o ON o.datasetH1 = d.datasetH1 AND o.datasetH2 = d.datasetH2 AND o.fluseason = d.fluseason AND o.sample = d.sample AND o.location_code = d.location_code),
rows0 AS (SELECT * FROM own UNION ALL SELECT * FROM fill), {_padded('rows0')} SELECT frame_id, location_code, season_week, value, week_enddate, origin FROM padded""")
def _(spark, d):
    return fr.build_frames(stored(spark, d), axis(spark, d), MIX, "random")


@query("F15_check_frames", f"WITH {FRAMES}, {_OWN}, {_padded('own')} SELECT frame_id, count(*) AS n FROM padded GROUP BY frame_id HAVING count(*) <> 53 * (SELECT count(*) FROM axis)")
def _(spark, d):
    return fr.check_frames(fr.pad_weeks(_own(spark, d), axis(spark, d)), axis(spark, d)).select("frame_id", "n")


@query("F16_main_origin", f"WITH {_BUILT}, n AS (SELECT frame_id, origin, count(*) AS c FROM padded GROUP BY ALL) SELECT frame_id, origin AS main_origin FROM n QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY c DESC, origin) = 1")
def _(spark, d):
    return fr.main_origin(fr.build_frames(stored(spark, d), axis(spark, d), MIX, "zeros"))


_F17 = f"""WITH {FRAMES}, {_OWN}, {_padded('own')}, c AS (SELECT frame_id, season_week - 1 AS w, CAST(location_code AS INTEGER) - 1 AS p, value FROM padded)
SELECT frame_id, CAST(w AS INTEGER) AS w, list(coalesce(value, 0) ORDER BY p) AS v FROM (SELECT x.frame_id, x.w, x.p, c.value FROM (SELECT frame_id, w, unnest(range(0, 64)) AS p FROM (SELECT DISTINCT frame_id, unnest(range(0, 64)) AS w FROM own)) x LEFT JOIN c ON c.frame_id = x.frame_id AND c.w = x.w AND c.p = x.p) GROUP BY frame_id, w"""


@query("F17_frames_to_tensor", _F17)
def tensor_rows(spark, d):
    t = tn.frames_to_tensor(fr.pad_weeks(_own(spark, d), axis(spark, d)), placed_axis(spark, d))
    return t.select("frame_id", F.posexplode("tensor").alias("w", "v"))


def placed_axis(spark, d):
    return axis(spark, d).withColumn("place", F.col("location_code").cast("int") - 1)


@query("F18_tensor_to_long", f"WITH {FRAMES}, {_OWN}, {_padded('own')}, g AS (SELECT f.frame_id, CAST(unnest(range(1, 54)) AS INTEGER) AS season_week, a.location_code FROM (SELECT DISTINCT frame_id FROM own) f, axis a) SELECT g.frame_id, g.season_week, g.location_code, coalesce(p.value, 0) AS value FROM g LEFT JOIN padded p ON p.frame_id = g.frame_id AND p.season_week = g.season_week AND p.location_code = g.location_code")
def _(spark, d):
    a = placed_axis(spark, d)
    return tn.tensor_to_long(tn.frames_to_tensor(fr.pad_weeks(_own(spark, d), axis(spark, d)), a), a)


@query("F19_origin_segments", f"WITH {FRAMES}, s AS (SELECT split_part(frame_id, '/', 1) AS source, row_number() OVER (ORDER BY frame_id) - 1 AS pos FROM frames), g AS (SELECT *, sum(CASE WHEN source <> prev THEN 1 ELSE 0 END) OVER (ORDER BY pos) AS segment FROM (SELECT *, lag(source) OVER (ORDER BY pos) AS prev FROM s)) SELECT CAST(segment AS BIGINT) AS segment, source, CAST(min(pos) AS INTEGER) AS first, CAST(max(pos) AS INTEGER) AS last, count(*) AS n FROM g GROUP BY segment, source")
def _(spark, d):
    return fr.origin_segments(frames(spark, d)[1].select("frame_id", F.col("frame_id").alias("main_origin")))


@query("F20_sample_trajectories", f"WITH {OBS}, k AS (SELECT DISTINCT datasetH2, fluseason, sample FROM obs), c AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY datasetH2, fluseason ORDER BY md5('sample|' || datasetH2 || '|' || fluseason || '|' || sample), sample) <= 2) SELECT o.datasetH2, o.fluseason, o.sample, count(*) AS n FROM obs o JOIN c ON o.datasetH2 = c.datasetH2 AND o.fluseason = c.fluseason AND o.sample = c.sample GROUP BY ALL")
def _(spark, d):
    return fr.sample_trajectories(observations(spark, d), ["datasetH2", "fluseason"], 2).groupBy("datasetH2", "fluseason", "sample").agg(F.count("*").alias("n"))


@query("F21_scaling_distribution", f"WITH {OBS} SELECT max(v) AS peak FROM (SELECT datasetH2, fluseason, sample, sum(value) AS v FROM obs WHERE datasetH1 = 'R' GROUP BY datasetH2, fluseason, sample, season_week) GROUP BY datasetH2, fluseason, sample")
def _(spark, d):
    return fr.scaling_distribution(observations(spark, d), "R")


@query("F22_min_locations_filter", f"WITH {OBS}, k AS (SELECT datasetH2, fluseason, sample FROM obs GROUP BY ALL HAVING count(DISTINCT location_code) >= 12) SELECT o.datasetH2, o.fluseason, o.sample, count(*) AS n FROM obs o JOIN k ON o.datasetH2 = k.datasetH2 AND o.fluseason = k.fluseason AND o.sample = k.sample GROUP BY ALL")
def _(spark, d):
    k = ["datasetH2", "fluseason", "sample"]
    return fr.min_locations_filter(observations(spark, d), k, 12).groupBy(*k).agg(F.count("*").alias("n"))


@query("A01_dataset_catalog", f"WITH {OBS} SELECT datasetH1, datasetH2, count(*) AS n_rows, count(DISTINCT fluseason) AS n_seasons, count(DISTINCT sample) AS n_samples, count(DISTINCT datasetH2) AS n_h2, count(DISTINCT fluseason) * count(DISTINCT sample) AS n_frames FROM obs GROUP BY GROUPING SETS ((datasetH1, datasetH2), (datasetH1))")
def _(spark, d):
    return fr.dataset_catalog(observations(spark, d))


@query("A02_national_weekly", f"WITH {OBS} SELECT datasetH1, datasetH2, fluseason, sample, season_week, sum(value) AS value FROM obs GROUP BY ALL")
def _(spark, d):
    return fr.national_weekly(observations(spark, d))


@query("A03_season_peaks", f"WITH {OBS} SELECT datasetH1, datasetH2, fluseason, sample, max(v) AS peak FROM (SELECT datasetH1, datasetH2, fluseason, sample, season_week, sum(value) AS v FROM obs GROUP BY ALL) GROUP BY ALL")
def _(spark, d):
    return fr.season_peaks(observations(spark, d))


@query("A04_trajectory_stats", f"WITH {OBS}, p AS (SELECT datasetH2, sample, count(DISTINCT season_week) AS w FROM obs GROUP BY ALL), q AS (SELECT datasetH2, count(DISTINCT location_code) AS n_locations, count(DISTINCT week_enddate) AS n_dates FROM obs GROUP BY ALL) SELECT p.datasetH2, count(*) AS n_trajectories, round(avg(w), 4) AS mean_weeks, n_locations, n_dates FROM p JOIN q ON p.datasetH2 = q.datasetH2 GROUP BY ALL")
def _(spark, d):
    return r6(fr.trajectory_stats(observations(spark, d)))


_CELLS = f"{FRAMES}, {_OWN}, cells AS MATERIALIZED (SELECT frame_id, location_code, season_week - 1 AS week_idx, value FROM own)"


def every_cell(spark, d):
    return _own(spark, d).select("frame_id", "location_code", (F.col("season_week") - 1).alias("week_idx"), "value")


def on_cells(name, sql):
    """Register a transform of the cells of every frame, copies too."""

    def keep(fn):
        return query(name, sql)(lambda spark, d: fn(every_cell(spark, d)))

    return keep


@query("A27_value_stats", f"WITH {FRAMES}, {_OWN}, {_padded('own')}, n AS (SELECT count(DISTINCT frame_id) * 4096 AS n FROM own) SELECT max(value) AS most, round(sum(value) / max(n), 4) AS mean, round(sqrt(sum(value * value) / max(n) - pow(sum(value) / max(n), 2)), 3) AS std FROM padded, n")
def _(spark, d):
    out = r6(tn.value_stats(tn.frames_to_tensor(fr.pad_weeks(_own(spark, d), axis(spark, d)), placed_axis(spark, d))))
    return out.withColumn("std", F.round("std", 3))


@on_cells("M01_scale", f"WITH {_CELLS} SELECT frame_id, round(sum(value * 2.5), 4) AS scaled, round(sum(value * 2.5 / 2.5), 4) AS back FROM cells GROUP BY ALL")
def _(c):
    v = F.col("value")
    return r6(c.groupBy("frame_id").agg(F.sum(tr.scale(v, 2.5)).alias("scaled"), F.sum(tr.unscale(tr.scale(v, 2.5), 2.5)).alias("back")))


@on_cells("M02_sqrt", f"WITH {_CELLS} SELECT frame_id, location_code, week_idx, round(sqrt(value), 4) AS root, round(sqrt(value) * sqrt(value), 4) AS back FROM cells")
def _(c):
    return r6(c.select("frame_id", "location_code", "week_idx", F.sqrt("value").alias("root"), tr.square(F.sqrt("value")).alias("back")))


@on_cells("M03_shift", f"WITH {_CELLS} SELECT frame_id, sum(value - 1) AS moved, sum(value - 1 + 1) AS back FROM cells GROUP BY ALL")
def _(c):
    v = F.col("value")
    return c.groupBy("frame_id").agg(F.sum(tr.shift(v)).alias("moved"), F.sum(tr.unshift(tr.shift(v))).alias("back"))


@on_cells("M04_roll_in_time", f"WITH {_CELLS} SELECT frame_id, location_code, CAST((week_idx + 20) % 64 AS INTEGER) AS week_idx, value FROM cells")
def _(c):
    return tr.roll_in_time(c, 20)


_SH = f"CAST(-15 + floor({_u('7', 'frame_id')} * 30) AS INTEGER)"


@on_cells("M05_random_roll_in_time", f"WITH {_CELLS} SELECT frame_id, location_code, CAST((week_idx + {_SH} + 64) % 64 AS INTEGER) AS week_idx, value FROM cells")
def _(c):
    return tr.random_roll(c, -15, 15, 7)


@on_cells("M06_random_pad_in_time", f"WITH {_CELLS}, s AS (SELECT frame_id, location_code, {_SH} AS s, CAST((week_idx + {_SH} + 64) % 64 AS INTEGER) AS week_idx, value FROM cells) SELECT frame_id, location_code, week_idx, CASE WHEN (s > 0 AND week_idx < s) OR (s < 0 AND week_idx >= 64 + s) THEN 0 ELSE value END AS value FROM s")
def _(c):
    return tr.random_pad(c, -15, 15, 7)


@on_cells("M07_random_scale", f"WITH {_CELLS} SELECT frame_id, location_code, week_idx, round(value * (0.1 + {_u('7', 'frame_id')} * 1.8), 4) AS value FROM cells")
def _(c):
    return r6(tr.random_scale(c, 0.1, 1.9, 7))


_K3 = "frame_id || '|' || week_idx || '|' || location_code"


def _z(seed: str) -> str:
    return f"(sqrt(-2 * ln(greatest({_u(seed + 'a', _K3)}, 1e-12))) * cos(2 * pi() * {_u(seed + 'b', _K3)}))"


@on_cells("M08_random_noise", f"WITH {_CELLS} SELECT frame_id, location_code, week_idx, round(value * (1 + 0.1 * {_z('7')}), 3) AS value FROM cells")
def _(c):
    return tr.random_noise(c, 0.1, 7).withColumn("value", F.round("value", 3))


_DELTA = 4 / math.sqrt(17)


@query("M09_skewed_noise", f"WITH {_CELLS} SELECT frame_id, location_code, week_idx, round(greatest(0, value * (0.9 + 0.2 * ({_DELTA!r} * abs({_z('7x')}) + {math.sqrt(1 - _DELTA * _DELTA)!r} * {_z('7y')}))), 4) + 0 AS value FROM cells")
def _(spark, d):
    return r6(tr.skewed_noise(every_cell(spark, d), 4.0, 0.9, 0.2, 7))


def _fine(keys: str, part: int = 0) -> str:
    return f"((('0x' || substr(md5('7|' || {keys}), {1 + 13 * part}, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


# inversion up to a mean of 30 by the distribution function of each mean, above it the first attempt that holds
_POIS = f"""small_draws AS MATERIALIZED (SELECT frame_id, location_code, week_idx, value AS m, {_fine(_K3)} AS u FROM cells WHERE value <= 30),
terms AS (SELECT m, CAST(unnest(range(0, 121)) AS INTEGER) AS k FROM (SELECT DISTINCT m FROM small_draws)),
cdf AS MATERIALIZED (SELECT m, k, sum(exp(CASE WHEN k = 0 THEN 0 ELSE k * ln(m) END - m - lgamma(k + 1))) OVER (PARTITION BY m ORDER BY k) AS c FROM terms WHERE m > 0 OR k = 0),
small AS (SELECT frame_id, location_code, week_idx, CAST(coalesce(k + 1, 0) AS DOUBLE) AS value FROM small_draws d ASOF LEFT JOIN cdf ON cdf.m = d.m AND d.u >= cdf.c),
tried AS MATERIALIZED (SELECT frame_id, location_code, week_idx, value AS m, i, {_fine(_K3 + " || '|' || i")} - 0.5 AS u, {_fine(_K3 + " || '|' || i", 1)} AS v, 0.931 + 2.53 * sqrt(value) AS b
  FROM (SELECT *, unnest(range(0, 16)) AS i FROM cells WHERE value > 30)),
judged AS (SELECT *, floor((2 * (-0.059 + 0.02483 * b) / (0.5 - abs(u)) + b) * u + m + 0.43) AS k, 0.5 - abs(u) AS us FROM tried),
held AS (SELECT * FROM judged WHERE (us >= 0.07 AND v <= 0.9277 - 3.6224 / (b - 2)) OR (k >= 0 AND NOT (us < 0.013 AND v > us)
  AND ln(v) + ln(1.1239 + 1.1328 / (b - 3.4)) - ln((-0.059 + 0.02483 * b) / (us * us) + b) <= -m + k * ln(m) - lgamma(greatest(k, 0) + 1))),
pois AS MATERIALIZED (SELECT * FROM small UNION ALL SELECT frame_id, location_code, week_idx, arg_min(k, i) AS value FROM held GROUP BY ALL)"""


@query("M10_poisson", f"WITH {_CELLS}, {_POIS} SELECT * FROM pois")
def _(spark, d):
    return tr.poisson(every_cell(spark, d), 7)


_PAD = f"CAST(-4 + floor({_u('7pad', 'frame_id')} * 8) AS INTEGER)"


@query("M11_enrich_recipes", f"""WITH {_CELLS}, {_POIS}, s AS (SELECT frame_id, location_code, {_PAD} AS s, CAST((week_idx + {_PAD} + 64) % 64 AS INTEGER) AS week_idx, value FROM pois)
SELECT frame_id, location_code, week_idx, round((CASE WHEN (s > 0 AND week_idx < s) OR (s < 0 AND week_idx >= 64 + s) THEN 0 ELSE value END) * (0.7 + {_u('7scale', 'frame_id')} * 0.6), 4) AS value FROM s""")
def _(spark, d):
    return r6(tr.enrich(every_cell(spark, d), "PoisPadScaleSmall", 7))


_ST = "st AS (SELECT max(value) AS most, avg(value) AS mean, stddev_pop(value) AS std FROM cells)"


def _stats(c):
    return c.agg(F.max("value").alias("most"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


@on_cells("M12_transform_recipes", f"WITH {_CELLS}, {_ST} SELECT frame_id, location_code, week_idx, round(2 * value / most, 4) AS lins, round(2 * sqrt(value / most), 4) AS root, round((ln(1 + value) - ln(mean)) / ln(std), 4) AS logzs, round((value - mean) / std, 4) AS linszs FROM cells, st")
def _(c):
    s = [F.col("most"), F.col("mean"), F.col("std")]
    j = c.join(F.broadcast(_stats(c)))
    return r6(j.select("frame_id", "location_code", "week_idx", *[tr.forward(n, F.col("value"), *s).alias(a) for n, a in (("Lins", "lins"), ("Sqrt", "root"), ("LogZs", "logzs"), ("LinsZs", "linszs"))]))


@query("M13_roundtrip_check", f"""WITH {_CELLS}, {_ST}, f AS (SELECT frame_id, location_code, week_idx, most, mean, std, 2 * value / most AS l, 2 * sqrt(value / most) AS r, (ln(1 + value) - ln(mean)) / ln(std) AS g, (value - mean) / std AS z FROM cells, st)
SELECT frame_id, location_code, week_idx, round(l * most / 2, 4) AS lins, round(pow(r / 2, 2) * most, 4) AS root, round(exp(g * ln(std) + ln(mean)) - 1, 4) + 0 AS logzs, round(z * std + mean, 4) + 0 AS linszs FROM f""")
def _(spark, d):
    c = every_cell(spark, d)
    return r6(tr.roundtrip(c, _stats(c)).drop("value").withColumnsRenamed({"Lins": "lins", "Sqrt": "root", "LogZs": "logzs", "LinsZs": "linszs"}))


@query("M14_repeat_dataset", f"WITH {FRAMES} SELECT frame_id, CAST(r AS INTEGER) AS repeat, md5('0|' || frame_id || '|' || r) AS position FROM (SELECT frame_id, unnest(range(0, 9)) AS r FROM frames)")
def _(spark, d):
    return tr.repeat_dataset(frames(spark, d)[1], 9)


_TWELVE = [f"{i:02d}" for i in range(1, 13)]


@query("V03_place_columns", f"WITH {OBS} SELECT week_enddate, " + ", ".join(f"sum(CASE WHEN location_code = '{p}' THEN value END) AS \"{p}\"" for p in _TWELVE) + " FROM obs GROUP BY ALL")
def _(spark, d):
    return tn.place_columns(observations(spark, d), "week_enddate", _TWELVE)


@query("draws_uniform", f"WITH {OBS} SELECT datasetH2, fluseason, sample, round({_u('x', 'datasetH2 || chr(124) || fluseason || chr(124) || sample')}, 6) AS u FROM (SELECT DISTINCT datasetH2, fluseason, sample FROM obs)")
def _(spark, d):
    k = observations(spark, d).select("datasetH2", "fluseason", "sample").distinct()
    return k.withColumn("u", F.round(dr.uniform("x", "datasetH2", "fluseason", "sample"), 6))


@query("X06_origin_parts", f"WITH {FRAMES}, {ZEROS} SELECT DISTINCT frame_id, split_part(origin, '/', 1) AS top, regexp_extract(origin, '\\[(filled_[^\\]]*)\\]', 1) AS fill FROM zeros")
def _(spark, d):
    obs, f = frames(spark, d)
    z = fr.fill_zeros(fr.find_missing_locations(f, obs, axis(spark, d)), obs)
    return z.select("frame_id", nm.origin_top(F.col("origin")).alias("top"), nm.origin_fill(F.col("origin")).alias("fill")).distinct()
