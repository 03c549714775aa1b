"""Scores on known values."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from epiframes.operators.scoring import score

DAY = dt.date(2024, 1, 6)


def scored(spark, observed, quantiles):
    rows = [("m", "g", "2023", DAY, DAY, "01", 0, q, float(p), float(observed)) for q, p in quantiles]
    df = spark.createDataFrame(rows, "model string, `group` string, season string, reference_date date, target_end_date date, location string, horizon int, quantile double, predicted double, observed double")
    return score(df).head()


def pinball(observed, quantiles):
    return sum(2 * ((observed < p) - q) * (p - observed) for q, p in quantiles) / len(quantiles)


THREE = [(0.25, 8), (0.5, 10), (0.75, 14)]


@pytest.mark.parametrize(("observed", "bias", "inside"), [(10, 0.0, 1.0), (8, 0.5, 1.0), (14, -0.5, 1.0), (9, 0.5, 1.0), (20, -1.0, 0.0), (1, 1.0, 0.0)])
def test_three_quantiles(spark, observed, bias, inside):
    r = scored(spark, observed, THREE)
    assert r.wis == pytest.approx(pinball(observed, THREE)) and r.ae_median == abs(observed - 10)
    assert r.bias == pytest.approx(bias) and r.interval_coverage_50 == inside


def test_on_the_median_only_dispersion_is_left(spark):
    r = scored(spark, 10, THREE)
    assert r.overprediction == 0 and r.underprediction == 0 and r.dispersion == pytest.approx(r.wis)


@pytest.mark.parametrize("observed", [2.0, 7.5, 10.0, 13.0, 40.0])
def test_parts_add_up_over_all_levels(spark, observed):
    from epiframes.schemas import QUANTILES

    levels = [(q, 5 + 10 * q) for q in QUANTILES]
    r = scored(spark, observed, levels)
    assert r.wis == pytest.approx(pinball(observed, levels))
    assert r.dispersion + r.overprediction + r.underprediction == pytest.approx(r.wis)
    assert r.interval_coverage_90 == float(5.5 <= observed <= 14.5)


def test_ties_of_all_quantiles(spark):
    r = scored(spark, 5, [(q, 5) for q, _ in THREE])
    assert r.wis == 0 and r.bias == 0 and r.interval_coverage_50 == 1


def test_a_single_quantile_and_a_missing_median(spark):
    r = scored(spark, 12, [(0.5, 10)])
    assert r.wis == pytest.approx(2) and r.ae_median == 2 and r.dispersion == 0 and r.interval_coverage_50 is None
    r = scored(spark, 12, [(0.25, 8), (0.75, 14)])
    assert r.ae_median is None and r.wis == pytest.approx(pinball(12, [(0.25, 8), (0.75, 14)])) and r.interval_coverage_50 == 1


def test_quantiles_equal_percentile(spark):
    """Cells of one to forty values and a large one, ties, nulls and cells of nulls only, bit for bit."""
    from epiframes.operators.forecasts import ensemble_quantiles
    from epiframes.schemas import QUANTILES

    rnd = random.Random(4)
    rows = [(c, None, rnd.choice([round(rnd.uniform(-50, 1e5), 2), 7.0, None])) for c in range(60) for _ in range(rnd.randint(1, 40))]
    rows += [(99, "x", rnd.random()) for _ in range(5000)] + [(100, "y", None)]
    df = spark.createDataFrame(rows, "c int, k string, value double").repartition(5)
    got = {(r.c, r["quantile"]): r.value for r in ensemble_quantiles(df, ["c", "k"]).collect()}
    want = df.groupBy("c").agg(F.percentile("value", F.lit(list(QUANTILES))).alias("p")).collect()
    assert got == {(r.c, q): v for r in want if r.p for q, v in zip(QUANTILES, r.p, strict=True)}
    assert "ObjectHashAggregate" not in ensemble_quantiles(df, ["c"])._jdf.queryExecution().executedPlan().toString()


def test_distinct_counts(spark):
    """Dates, whole numbers of both signs and of several ranges of positions, texts, nulls, groups without values."""
    from epiframes.functions.bitmaps import distinct_counts

    rnd = random.Random(6)
    day = lambda: rnd.choice([None, dt.date(1900, 1, 1), dt.date(2024, 1, 1) + dt.timedelta(rnd.randint(-400, 400))])
    rows = [(rnd.choice("ab"), day(), rnd.choice([None, 0, -1, 1, rnd.randint(-10**6, 10**6)]), rnd.choice([None, "", "x", "é", f"w{rnd.randint(0, 60)}"])) for _ in range(900)] + [("c", None, None, None)]
    df = spark.createDataFrame(rows, "g string, d date, i long, s string").repartition(4)
    got = distinct_counts(df, ["g"], ["d", "i", "s"], n=(F.count("*"), F.sum("_o_n")), top=(F.max("i"), F.max("_o_top"))).collect()
    want = df.groupBy("g").agg(F.countDistinct("d").alias("n_d"), F.countDistinct("i").alias("n_i"), F.countDistinct("s").alias("n_s"), F.count("*").alias("n"), F.max("i").alias("top")).collect()
    key = lambda r: (r.g, r.n, r.top, r.n_d, r.n_i, r.n_s)
    assert {key(r) for r in got} == {key(r) for r in want} and len(got) == 3
    assert distinct_counts(df.where("g = 'c'"), ["g"], ["s"]).head().n_s == 0


def test_overlap_of_empty_tables(spark):
    from epiframes.operators.hub import overlap_report

    a = spark.createDataFrame([("x", 1), ("y", 1), (None, 2)], "k string, n int")
    got = {r.dimension: tuple(r)[1:] for r in overlap_report(a, a.where("false"), ("k", "n")).collect()}
    assert got == {"k": (2, 0, 0), "n": (2, 0, 0)}
    assert {tuple(r)[1:] for r in overlap_report(a.where("false"), a.where("false"), ("k",)).collect()} <= {(0, 0, 0)}
