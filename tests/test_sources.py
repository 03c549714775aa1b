"""Files written and read back."""

import datetime as dt
import json

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from epiframes.operators.experiments import BASELINE, essential_scenarios, scenario_grid
from epiframes.operators.hub import check_score_input
from epiframes.operators.masks import mask_grid, mask_locations
from epiframes.operators.picks import place_to_code
from epiframes.schemas import OBSERVATIONS, RUNS
from epiframes.sources import readers as rd
from epiframes.sources import sinks as sk
from epiframes.sources.named_files import published
from epiframes.sources.npy import read_npy
from epiframes.sources.shared import owned, shared_dir


def test_truth_and_locations(spark, tmp_path):
    (tmp_path / "t.csv").write_text("date,location,location_name,value,weekly_rate\n2023-10-07, 01 ,Alabama,3.5,0.1\n2023-10-07,US,US,NaN,0.1\nbad,02,x,1,1\n")
    got = [tuple(r) for r in rd.read_truth(spark, str(tmp_path / "t.csv")).collect()]
    assert got == [(dt.date(2023, 10, 7), "01", 3.5), (dt.date(2023, 10, 7), "US", None), (None, "02", 1.0)]
    (tmp_path / "l.csv").write_text("abbreviation, location_name, population, location_code, geoid\n AL, Alabama, 5000, 01, 0100\n")
    r = rd.read_locations(spark, str(tmp_path / "l.csv")).head()
    assert (r.abbreviation, r.location_code, r.population) == ("AL", "01", 5000)


def test_hub_folders(spark, tmp_path):
    for m in ("A-x", "B-y", "C-z"):
        (tmp_path / "out" / m).mkdir(parents=True)
        (tmp_path / "out" / m / f"2023-10-14-{m}.csv").write_text("location,value\n01,2\n")
    (tmp_path / "out" / "A-x" / "notes.csv").write_text("location,value\n01,9\n")
    got = rd.read_hub_forecasts(spark, str(tmp_path / "out"), ignore=("C-z",)).select("model", "file_date", "value").collect()
    assert sorted((r.model, str(r.file_date), r.value) for r in got) == [("A-x", "2023-10-14", "2"), ("B-y", "2023-10-14", "2")]


def test_run_folders(spark, tmp_path):
    d = tmp_path / "runs" / "i806::m_U::ds_D::tr_Sqrt::ri_No::inpaint_CoPaint::conf_celebahq::2023-12-09"
    d.mkdir(parents=True)
    (d / "2023-12-09.csv").write_text("location,value\n01,2\n")
    (d / "2023-12-09-copaint.csv").write_text("location,value\n01,3\n")
    got = rd.read_run_forecasts(spark, str(tmp_path / "runs")).collect()
    assert [(r.model, r.value) for r in got] == [("i806::m_U::ds_D::tr_Sqrt::ri_No::inpaint_CoPaint::celebahq", "2")]


def test_trajectories(spark, tmp_path):
    for m, f, kind in (("M1", "a", "quantile"), ("M1", "b", "sample"), ("M1", "c", "sample"), ("my_example", "a", "sample")):
        (tmp_path / "t" / m).mkdir(parents=True, exist_ok=True)
        pq.write_table(pa.table({"origin_date": ["2024-01-01"], "output_type": [kind], "value": [1.0]}), tmp_path / "t" / m / f"{f}.parquet")
    got = rd.read_trajectories(spark, str(tmp_path / "t")).collect()
    assert len(got) == 1 and got[0].run_grouping is None


def test_observations_round_trip(spark, tmp_path):
    rows = [("fluview", "fluview", 2010, "1", "01", 1, dt.date(2010, 8, 7), 2.0, 0.1)]
    sk.write_observations(spark.createDataFrame(rows, OBSERVATIONS), str(tmp_path / "o"))
    assert [tuple(r[c] for c in OBSERVATIONS.fieldNames()) for r in rd.read_observations(spark, str(tmp_path / "o")).collect()] == rows


def test_tensors(spark, tmp_path):
    a = np.arange(2 * 3 * 4, dtype=float).reshape(2, 3, 4)
    np.save(tmp_path / "x.npy", a)
    df = rd.read_sample_tensors(spark, str(tmp_path))
    assert df.count() == 24 and df.agg(F.sum("value")).head()[0] == a.sum()
    assert df.where("sample_id = 1 AND week_idx = 2 AND place = 3").head().value == a[1, 2, 3]


def test_hub_files_and_summary(spark, tmp_path):
    rows = [("m1", dt.date(2023, 10, 14), "01", 1.0), ("m1", dt.date(2023, 10, 14), "02", 2.0), ("m2", dt.date(2023, 10, 21), "01", 3.0)]
    sk.write_hub_forecasts(spark.createDataFrame(rows, "model string, reference_date date, location string, value double"), str(tmp_path / "h"))
    files = sorted(p.relative_to(tmp_path / "h").as_posix() for p in (tmp_path / "h").rglob("*.csv"))
    assert files == ["m1/2023-10-14-m1.csv", "m2/2023-10-21-m2.csv"]
    back = rd.read_hub_forecasts(spark, str(tmp_path / "h")).select("model", "reference_date", "location", F.col("value").cast("double"), "file_date").collect()
    assert sorted(tuple(r) for r in back) == [(m, str(d), p, v, d) for m, d, p, v in rows]
    sk.write_summary_json(spark.range(3).agg(F.count("*").alias("n")), str(tmp_path / "s"))
    assert [json.loads(x) for p in (tmp_path / "s").glob("*.json") for x in p.read_text().splitlines()] == [{"n": 3}]


@pytest.mark.parametrize("shape", [(7, 3, 4), (5, 2, 3, 4), (1, 1, 1)])
@pytest.mark.parametrize("dtype", ["<f8", "<f4", ">i4"])
def test_tensor_ranges(spark, tmp_path, shape, dtype):
    """Small ranges, several files and folders, filters on the sample, other types than doubles."""
    arrays = {"a.npy": np.arange(np.prod(shape)).reshape(shape).astype(dtype), "b/c.npy": -np.arange(np.prod(shape)).reshape(shape).astype(dtype)}
    (tmp_path / "b").mkdir()
    for name, a in arrays.items():
        np.save(tmp_path / name, a)
    (tmp_path / "notes.txt").write_text("x")
    df = read_npy(spark, str(tmp_path), range_bytes=50)
    assert df.rdd.getNumPartitions() >= (2 if shape[0] == 1 else 6)
    want = {(f, i[0], 0 if len(shape) == 3 else i[1], i[-2], i[-1], float(v)) for f, a in arrays.items() for i, v in np.ndenumerate(a)}
    assert {tuple(r) for r in df.collect()} == want
    for text, keep in (("sample_id = 2", {2}), ("sample_id IN (0, 4) AND value > -5", {0, 4}), ("sample_id >= 1 AND sample_id < 3", {1, 2}), ("sample_id > 90", set()), ("sample_id BETWEEN 1 AND 2 AND sample_id = 2", {2})):
        got = df.where(text)
        assert {tuple(r) for r in got.collect()} == {w for w in want if w[1] in keep and not ("value" in text and w[5] <= -5)}
        assert got.rdd.getNumPartitions() <= 2 * max(1, len(keep))
    assert {tuple(r) for r in rd.read_sample_tensors(spark, str(tmp_path), whole_files=True).select("sample_id", "feature", "week_idx", "place", "value").collect()} == {w[1:] for w in want}


def test_tensor_files_that_are_refused(spark, tmp_path):
    np.save(tmp_path / "f.npy", np.asfortranarray(np.zeros((2, 3, 4))))
    with pytest.raises(Exception, match="C-ordered"):
        read_npy(spark, str(tmp_path / "f.npy")).count()
    np.save(tmp_path / "o.npy", np.array([[["a"]]], dtype=object), allow_pickle=True)
    with pytest.raises(Exception, match="only numbers"):
        read_npy(spark, str(tmp_path / "o.npy")).count()


def test_failed_hub_leaves_nothing(spark, tmp_path):
    """A job that breaks off in one task publishes no file, and a later one is read alone."""
    path = str(tmp_path / "hub")
    rows = [(f"m{i}", dt.date(2023, 10, 14), "01", float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "model string, reference_date date, location string, value double")
    broken = df.withColumn("model", F.when(F.col("model") == "m7", F.repeat(F.lit("x"), F.lit(300))).otherwise(F.col("model")))
    with pytest.raises(Exception, match="name too long"):
        sk.write_hub_forecasts(broken, path)
    assert published(spark, path) == []
    assert not [p for p in (tmp_path / "hub").rglob("*.csv")]
    sk.write_hub_forecasts(df, path)
    assert len(published(spark, path)) == 12
    (tmp_path / "hub" / "m1" / "2020-01-01-m1.csv").write_text("reference_date,location,value\n2020-01-01,01,5\n")
    got = rd.read_hub_forecasts(spark, path).select("model", F.col("value").cast("double")).collect()
    assert sorted(map(tuple, got)) == sorted((m, v) for m, _, _, v in rows)


def test_folders_belong_to_their_block(spark):
    import threading

    def exists(path):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)

    outer = written_here(spark)
    with owned(spark):
        inner, seen = written_here(spark), []

        def other():
            seen.append(written_here(spark))
            with owned(spark):
                seen.append(written_here(spark))

        t = threading.Thread(target=other)
        t.start()
        t.join()
        assert exists(inner) and exists(seen[0]) and not exists(seen[1])
    assert exists(outer) and exists(seen[0]) and not exists(inner)


def written_here(spark):
    path = shared_dir(spark)
    spark.range(1).write.parquet(path)
    return path


def test_run_log(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"run_id": "a", "scenario_id": 1, "status": "FINISHED"}\n{"run_id": "b", "scenario_id": 1, "status": "FAILED"}\n')
    assert [r.run_id for r in rd.read_run_log(spark, str(tmp_path / "r.json"), RUNS).collect()] == ["a"]


def test_scenarios(spark):
    grid = scenario_grid(spark)
    assert grid.count() == 1280 and all(grid.where("scenario_id = 804").head()[k] == v for k, v in BASELINE.items())
    want = {804, 36, 292, 548, 1060, 868, 932, 996, 772, 788, 820, 800, 808, 812, 805, 806, 807}
    assert {r.scenario_id for r in essential_scenarios(grid).collect()} == want


def test_guards(spark):
    f = spark.createDataFrame([("m", dt.date(2024, 1, 6), "01", 1.0, 0.5)], "model string, target_end_date date, location string, value double, output_type_id double")
    t = spark.createDataFrame([(dt.date(2024, 1, 6), "02", 1.0)], "date date, location string, value double")
    with pytest.raises(ValueError):
        check_score_input(f, t)
    grid = mask_grid(spark.createDataFrame([("01", 0)], "location_code string, place int"))
    with pytest.raises(ValueError):
        mask_locations(grid, ["99"])
    loc = spark.createDataFrame([("AL", "01")], "abbreviation string, location_code string")
    ok = spark.createDataFrame([("AL",), ("01",), ("US",)], "place string")
    assert [r.location_code for r in place_to_code(ok, loc).collect()] == ["01", "01", "US"]
    with pytest.raises(Exception, match="unknown place"):
        place_to_code(spark.createDataFrame([("XX",)], "place string"), loc).collect()


def test_history_by_season(spark, tmp_path):
    """A replaced season changes its own files only; doing it again changes nothing; a write that broke off is not seen."""
    from epiframes.sources import history as hs

    path = str(tmp_path / "h")
    files = lambda: {p.relative_to(path).as_posix(): p.stat().st_mtime_ns for p in (tmp_path / "h").rglob("*") if p.is_file() and not p.name.startswith((".", "_SUCCESS"))}
    rows = [(y, p, float(y + i)) for y in (2020, 2021, 2022) for i, p in enumerate(["01", "02", "02"])]
    df = spark.createDataFrame(rows, "fluseason int, location_code string, value double")
    read = lambda: sorted((r.fluseason, r.location_code, r.value) for r in hs.read_history(spark, path).collect())
    hs.write_seasons(df, path)
    assert read() == sorted(rows)
    before = files()
    assert hs.write_seasons(df.repartition(3), path) and files() == before
    new = df.withColumn("value", -F.col("value"))
    hs.replace_season(new, path, 2021)
    changed = {k for k in files() if k not in before}
    assert all("2021" in k for k in changed) and all(files()[k] == t for k, t in before.items())
    want = sorted((y, p, -v if y == 2021 else v) for y, p, v in rows)
    assert read() == want
    after = files()
    hs.replace_season(new, path, 2021)
    assert files() == after and hs.replace_season(new, path, 1999) is None
    new.where("fluseason = 2022").write.parquet(f"{path}/fluseason=2022/version=half")
    assert read() == want
    hs.replace_season(df, path, 2021)  # back to a version that is there already
    assert read() == sorted(rows)
