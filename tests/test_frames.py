"""The frame builder's cases on a small synthetic table."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from epiframes.functions import seasons as se
from epiframes.operators import frames as fr
from epiframes.schemas import OBSERVATIONS

PLACES = ["01", "06", "11", "12", "22"]


def rows(h1, year, places, sample="1", h2=None, weeks=range(1, 54)):
    start = dt.date(year, 8, 7)
    return [(h1, h2 or h1, year, sample, p, w, start + dt.timedelta(7 * (w - 1)), float(w + i), None) for i, p in enumerate(places) for w in weeks]


@pytest.fixture(scope="module")
def obs(spark):
    data = rows("fluview", 2010, ["01", "06", "11"]) + rows("fluview", 2021, PLACES) + rows("flusurv", 2021, ["01", "06"], weeks=range(5, 20))
    data += rows("SMH", 2024, ["01", "06", "12", "22"], "1.0_NA_101", "round5") + rows("SMH", 2023, ["11"], "2", "a") + rows("SMH", 2023, ["11"], "1", "b") + rows("flepiR1", 2022, ["01"], weeks=range(3, 9))
    return spark.createDataFrame(data, OBSERVATIONS).repartition(3).cache()


@pytest.fixture(scope="module")
def axis(spark):
    return spark.createDataFrame([(p,) for p in PLACES], "location_code string")


def build(obs, axis, config, fill, **k):
    return fr.build_frames(obs, axis, config, fill, **k)


def test_basic_zeros(obs, axis):
    out = build(obs, axis, {"fluview": {"multiplier": 1}}, "zeros")
    assert out.select("frame_id").distinct().count() == 2
    assert out.columns[1:] == ["location_code", "season_week", "value", "week_enddate", "origin"]
    filled = out.where("location_code = '12' AND frame_id LIKE '%2010%'")
    assert filled.agg(F.max("value")).head()[0] == 0.0 and filled.where("origin LIKE '%filled_zeros%'").count() == 53
    assert fr.check_frames(out, axis).count() == 0
    assert not out.where("value IS NULL OR week_enddate IS NULL OR origin IS NULL").head(1)


def test_random(obs, axis):
    out = build(obs, axis, {"fluview": {"multiplier": 1}}, "random")
    got = {r.location_code for r in out.where("frame_id LIKE '%2010%'").select("location_code").distinct().collect()}
    assert {"12", "22"} <= got
    assert out.where("origin LIKE '%[filled_same_location_%'").count() == 2 * 53
    assert out.where("frame_id LIKE '%2010%' AND location_code = '01'").select("origin").distinct().head()[0] == "fluview/fluview/2010/1"


def test_error_and_skip(obs, axis):
    with pytest.raises(ValueError, match="Missing required locations"):
        build(obs, axis, {"fluview": {"multiplier": 1}}, "error")
    assert build(obs, axis, {"fluview": {"multiplier": 1}}, "skip").select("frame_id").distinct().count() == 1


def test_multipliers_and_copies(obs, axis):
    out = build(obs, axis, {"fluview": {"multiplier": 2}, "flusurv": {"multiplier": 1}}, "zeros")
    assert out.select("frame_id").distinct().count() == 5
    ten = build(obs, axis, {"fluview": {"multiplier": 5}}, "random")
    assert ten.select("frame_id").distinct().count() == 10
    assert ten.groupBy("frame_id", "location_code", "season_week").count().where("count > 1").count() == 0
    assert fr.check_frames(ten, axis).count() == 0


def test_proportions(obs, axis):
    out = build(obs, axis, {"fluview": {"proportion": 0.8, "total": 10}, "flusurv": {"proportion": 0.2, "total": 10}}, "zeros")
    n = {r[0]: r[1] for r in out.select(F.split("frame_id", "/")[0].alias("s"), "frame_id").distinct().groupBy("s").count().collect()}
    assert n == {"fluview": 8, "flusurv": 2}


def test_bad_configs(obs, axis):
    for config, fill in (({"fluview": {"multiplier": 1}, "flusurv": {"proportion": 1, "total": 3}}, "zeros"), ({"nope": {"multiplier": 1}}, "zeros"), ({"fluview": {"multiplier": 1}}, "guess")):
        with pytest.raises(ValueError):
            build(obs, axis, config, fill)


def test_filled_place_has_one_donor(obs, axis):
    out = build(obs, axis, {"flepiR1": {"multiplier": 1}, "SMH": {"multiplier": 2}}, "random")
    eleven = out.where("location_code = '11' AND frame_id LIKE 'SMH/round5%'")
    per = eleven.groupBy("frame_id").agg(F.count("*").alias("n"), F.countDistinct("season_week").alias("w"), F.countDistinct("origin").alias("o")).collect()
    assert len(per) == 2 and all((r.n, r.w, r.o) == (53, 53, 1) for r in per)


def test_gap_fill_carries_once(spark, axis):
    one = spark.createDataFrame([("f", "01", 1, 5.0, dt.date(2023, 8, 5), "o"), ("f", "01", 4, 9.0, dt.date(2023, 8, 26), "o")], "frame_id string, location_code string, season_week int, value double, week_enddate date, origin string")
    got = {r.season_week: r.value for r in fr.pad_weeks(one, axis).collect()}
    assert (got[1], got[2], got[3], got[4], got[5], got[53]) == (5.0, 5.0, 0.0, 9.0, 0.0, 0.0)
    assert {r.season_week: r.value for r in fr.pad_weeks(one, axis, carry="ffill").collect()}[3] == 5.0


def test_scaling_meets_a_target(spark, obs, axis):
    targets = spark.createDataFrame([(100.0,), (250.0,)], "peak double")
    out = build(obs, axis, {"fluview": {"multiplier": 2, "to_scale": True}}, "zeros", scaling=targets)
    peaks = {round(r.peak, 6) for r in fr.frame_peaks(out).collect()}
    assert peaks <= {100.0, 250.0} and out.where("origin NOT LIKE '%[scaled_to_%'").count() == 0


def test_same_result_for_any_partitioning(spark, obs, axis):
    seen = []
    for n in ("1", "7", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(build(obs, axis, {"fluview": {"multiplier": 2}}, "random").agg(F.bit_xor(F.xxhash64("frame_id", "location_code", "season_week", "value", "origin"))).head()[0])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(set(seen)) == 1


def test_season_goldens(spark):
    days = ["2023-11-25", "2023-08-01", "2023-08-10", "2023-07-30"]
    df = spark.createDataFrame([(d,) for d in days], "s string").select(F.col("s").cast("date").alias("d"))
    assert [r[0] for r in df.select(se.season_week(F.col("d"))).collect()] == [17, 1, 2, 52]
    assert df.limit(1).select(se.epiweek_to_enddate(F.lit(202053)), se.date_to_epiweek(F.lit("2021-01-02").cast("date"))).head() == (dt.date(2021, 1, 2), 53)
