"""Exact draws, order statistics, padding, donors and as-of joins against plain definitions."""

import datetime as dt
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from epiframes.functions.draws import uniform
from epiframes.operators import frames as fr
from epiframes.operators import transforms as tr
from epiframes.operators import truth as tu


@pytest.mark.parametrize("mean", [0.0, 0.3, 4.0, 29.9, 30.0, 30.5, 47.0, 900.0])
def test_poisson_law(spark, mean):
    """Chi-square of 20,000 draws in bins of at least 20 expected ones."""
    n = 20_000
    rows = spark.range(n).select(F.col("id").alias("frame_id"), F.lit(0).alias("week_idx"), F.lit("x").alias("location_code"), F.lit(mean).alias("value"))
    got = Counter(int(r.value) for r in tr.poisson(rows, f"law{mean}").select("value").collect())
    if mean == 0:
        assert got == {0: n}
        return
    p, bins, seen, want = lambda k: math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1)), [], 0, 0.0
    for k in range(int(mean + 12 * math.sqrt(mean) + 20)):
        seen, want = seen + got.pop(k, 0), want + n * p(k)
        if want >= 20:
            bins.append((seen, want))
            seen, want = 0, 0.0
    bins[-1] = (bins[-1][0] + seen, bins[-1][1] + want)
    assert not got
    chi, free = sum((a - b) ** 2 / b for a, b in bins), len(bins) - 1
    assert chi < free + 4 * math.sqrt(2 * free) + 4, (chi, free)


def test_log_factorial(spark):
    ks = [float(k) for k in (*range(30), 100, 1000, 10**6)]
    got = spark.createDataFrame([(k,) for k in ks], "k double").select("k", tr.log_factorial(F.col("k")).alias("l")).collect()
    assert all(r.l == pytest.approx(math.lgamma(r.k + 1), rel=1e-13, abs=1e-13) for r in got)


@pytest.mark.parametrize("few", [(4096, 256), (8, 3), (1, 1)])
def test_order_index(spark, few):
    rnd = random.Random(1)
    values = [rnd.random() for _ in range(400)] + [0.5] * 300 + [rnd.choice([0.25, 1e9, -3.0]) for _ in range(50)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "peak double").repartition(5)
    got = {r.peak: (r.low, r.high) for r in fr.order_index(df, "peak", *few).collect()}
    want, at = {}, 0
    for v, n in sorted(Counter(values).items()):
        want[v], at = (at + 1, at + n), at + n
    assert got == want
    assert fr.order_index(df.where("peak IS NULL"), "peak").count() == 0


def test_order_index_is_balanced_below_one(spark):
    """Rates in [0, 1) are dealt over many buckets."""
    df = spark.range(20_000).select((F.pmod(F.xxhash64("id"), F.lit(10**6)) / 1e6).alias("peak"))
    splits = fr.splitters(df, "peak").head().splits
    assert len(splits) > 200
    held = np.bincount(np.searchsorted(splits, [r.peak for r in df.collect()], side="right"))
    assert held.max() < 6 * held.mean()


def plain_pad(rows, carry):
    out = []
    by = defaultdict(list)
    for f, p, w, v, d, o in rows:
        by[f, p].append((w, d, o, v))
    for (f, p), x in by.items():
        x.sort(key=lambda r: r[:3])
        have = defaultdict(list)
        for r in x:
            have[r[0]].append(r)
        lo, hi, last, before = x[0][0], x[-1][0], None, None
        for w in range(1, 54):
            for r in have.get(w, [None]):
                v = r[3] if r else None
                if v is None and lo <= w <= hi:
                    v = (before if carry == "last" else last) or 0.0
                out.append((f, p, w, v or 0.0, r[1] if r else x[0][1], r[2] if r else x[0][2]))
            before = have[w][-1][3] if w in have else None
            last = before if before is not None else last
    return sorted(out)


@pytest.mark.parametrize("carry", ["last", "ffill"])
def test_pad_weeks(spark, carry):
    rnd = random.Random(2)
    day = lambda w: dt.date(2020, 8, 1) + dt.timedelta(7 * w)
    rows = [(f"f{i}", p, w, rnd.choice([None, float(w), 2.5]), day(w), f"o{i}{w}") for i in range(30) for p in ("01", "02") for w in sorted(rnd.sample(range(1, 54), rnd.choice([1, 2, 10, 50, 53])))]
    df = spark.createDataFrame(rows, "frame_id string, location_code string, season_week int, value double, week_enddate date, origin string").repartition(4)
    axis = spark.createDataFrame([("01",), ("02",)], "location_code string")
    got = sorted((r.frame_id, r.location_code, r.season_week, r.value, r.week_enddate, r.origin) for r in fr.pad_weeks(df, axis, carry).collect())
    assert got == plain_pad(rows, carry)


def test_padding_takes_one_exchange(spark):
    df = spark.createDataFrame([("f", "01", 3, 1.0, dt.date(2020, 8, 1), "o")], "frame_id string, location_code string, season_week int, value double, week_enddate date, origin string")
    plan = fr.pad_weeks(df, spark.createDataFrame([("01",)], "location_code string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_random_donors(spark):
    """The donor is the one at the hashed position among the candidates of the best tier, and all of them come up."""
    rnd = random.Random(7)
    keys = {(h1, f"{h1}{k}", y, str(s)) for h1 in "ABC" for k in (1, 2) for y in range(2010, 2016) for s in range(3) if rnd.random() < 0.6}
    obs = [(*k, p, 1, 1.0, dt.date(2020, 1, 4)) for k in sorted(keys) for p in ("01", "02", "03") if rnd.random() < 0.5 and not (p == "03" and k[0] != "C")]
    schema = "datasetH1 string, datasetH2 string, fluseason int, sample string, location_code string, season_week int, value double, week_enddate date"
    df = spark.createDataFrame(obs, schema).repartition(4)
    have = {(k, o[4]) for o in obs for k in [tuple(o[:4])]}
    miss = [(f"{'/'.join(map(str, k))}_{c}", *k, p, "o") for k in sorted(keys) for p in ("01", "02", "03") for c in range(20) if (k, p) not in have]
    m = spark.createDataFrame(miss, "frame_id string, datasetH1 string, datasetH2 string, fluseason int, sample string, location_code string, origin string")
    us = {(r.frame_id, r.location_code): r.u for r in m.select("frame_id", "location_code", uniform(0, "frame_id", "location_code").alias("u")).collect()}
    by_year, by_sample = {}, {}
    for h1, h2, y, s, p, *_ in obs:
        by_year[p, h1, y] = min(by_year.get((p, h1, y), ("~", "")), (h2, s))
        by_sample[p, h1, y, s] = min(by_sample.get((p, h1, y, s), "~"), h2)
    got = {(r.frame_id, r.location_code): r for r in fr.fill_random_donors(m, df).collect()}
    assert len(got) == len(miss)
    drawn = defaultdict(set)
    for f, h1, _, y, s, p, _ in miss:
        one = [(h1, *by_year[k], k[2]) for k in sorted(by_year) if k[:2] == (p, h1) and k[2] != y]
        two = [(h1, by_sample[k], k[3], y) for k in sorted(by_sample) if k[:3] == (p, h1, y) and k[3] != s]
        others = sorted({k[1] for k in by_year if k[0] == p and k[1] != h1})
        three = [(others[0], *by_year[k], k[2]) for k in sorted(by_year) if k[:2] == (p, others[0])] if others else []
        best = one or two or three
        r = got[f, p]
        if not best:
            assert r.datasetH1 is None and r.note is None
            continue
        want = best[int(us[f, p] * len(best))]
        assert (r.datasetH1, r.datasetH2, r.sample, r.fluseason) == want
        assert r.note.startswith("filled_same_location_" + ("year_" if one else "sample_" if two else others[0]))
        drawn[h1, y, s, p].add(want)
    assert max(map(len, drawn.values())) > 3


def test_as_of_join(spark):
    rnd = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    time = lambda: rnd.choice([None, *[t0 + dt.timedelta(days=i) for i in range(30)]])
    left = [(i, rnd.choice(["a", "b", None]), rnd.choice([1, 2]), time()) for i in range(300)]
    right = [(rnd.choice(["a", "b", None]), rnd.choice([1, 2, 3]), time(), rnd.choice([None, 1.0, 2.0, 3.0])) for _ in range(200)]
    got = tu.as_of_join(spark.createDataFrame(left, "id int, loc string, k int, at timestamp").repartition(3), spark.createDataFrame(right, "loc string, k int, known timestamp, v double").repartition(2), ["loc", "k"], "at", "known", ["v"])
    assert got.columns == ["id", "loc", "k", "at", "v"]
    for r in got.collect():
        known = [(t, v is not None, v or 0) for loc, k, t, v in right if t is not None and r.at is not None and (loc, k) == (r.loc, r.k) and loc is not None and t <= r.at]
        want = max(known, default=None)
        assert r.v == (want[2] if want and want[1] else None)
    assert got.count() == 300


def test_truth_at_many_dates(spark):
    rnd = random.Random(5)
    day = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(days=i)
    revisions = [(p, day(d).date(), day(d + lag), float(rnd.randint(0, 9))) for p in "xy" for d in range(0, 60, 7) for lag in rnd.sample(range(40), 4)]
    refs = [(day(i).date(),) for i in (10, 33, 40, 70, 40)]
    v, dates = spark.createDataFrame(revisions, "location string, date date, as_of timestamp, value double"), spark.createDataFrame(refs, "reference_date date")
    want = {}
    for (r,) in refs:
        for p, d, t, x in sorted(revisions, key=lambda z: z[2]):
            if t.date() <= r:
                want[r, p, d] = x
    assert {(r.reference_date, r.location, r.date): r.value for r in tu.truth_as_of(v, dates).collect()} == want
    final = {(p, d): x for p, d, _, x in sorted(revisions, key=lambda z: z[2])}
    both = {(r.reference_date, r.location, r.date): (r.as_of_value, r.final) for r in tu.final_vs_asof(v, dates).collect()}
    assert both == {(r, p, d): (want.get((r, p, d)), x) for (r,) in refs for (p, d), x in final.items() if d <= r}
    for (r,) in refs:
        one = {(z.location, z.date): z.value for z in tu.truth_as_of(v, f"{r} 00:00:00").collect()}
        assert one == {(p, d): x for (q, p, d), x in want.items() if q == r}
