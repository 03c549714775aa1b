"""Rescaling of trajectories against a plain definition."""

import hashlib
import math

import pytest

from epiframes.operators import forecasts as fc


def plain_normal(seed, *keys):
    u = lambda s: int(hashlib.md5("|".join([s, *map(str, keys)]).encode()).hexdigest()[:8], 16) / 4294967296.0
    return math.sqrt(-2 * math.log(max(u(f"{seed}a"), 1e-12))) * math.cos(2 * math.pi * u(f"{seed}b"))


def test_rescale_to_last_obs(spark):
    last, start = {"01": 30.0, "02": 8.0}, {(p, s): float(s % 4) for p in ("01", "02") for s in range(40)}
    rows = [(p, s, w, float(s + w)) for p in last for s in range(40) for w in range(3)]
    frames = [spark.createDataFrame(x, y) for x, y in ((rows, "location string, sample_id int, week int, value double"), (list(last.items()), "location string, value double"), ([(*k, v) for k, v in start.items()], "location string, sample_id int, value double"))]
    got = {(r.location, r.sample_id, r.week): r.value for r in fc.rescale_to_last_obs(*frames).collect()}
    assert len(got) == len(rows)
    noise = {k: 1 + 0.05 * plain_normal("rescale", k[1], k[0]) for k in start}
    assert any(abs(z - 1) > 0.1 for z in noise.values())
    for p, s, w, v in rows:
        z = min(1.1, max(0.9, noise[p, s]))
        assert got[p, s, w] == pytest.approx(v * last[p] / start[p, s] * z if start[p, s] > 0 else v)
