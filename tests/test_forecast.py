from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rackpulse.operators import forecast as G

SERIES = "tick long, value double"


def brute_force(points, horizon):
    ticks, y = np.array([p[0] for p in points], float), np.array([p[1] for p in points])
    hod, day = (ticks // 12 % 24).astype(int), (ticks // 288).astype(int)
    days = np.unique(day)
    slope, intercept = np.polyfit(days, [y[day == d].mean() for d in days], 1)
    slope /= 288
    residual = y - slope * ticks - intercept
    cycle = np.array([residual[hod == h].mean() if (hod == h).any() else 0 for h in range(24)])
    sigma = (residual - cycle[hod]).std()
    future = np.arange(ticks[-1] + 12, ticks[-1] + 12 + 12 * horizon, 12)
    yhat = np.clip(slope * future + intercept + cycle[(future // 12 % 24).astype(int)], 0, None)
    return [(int(t), v, max(0, v - 1.28 * sigma), v + 1.28 * sigma) for t, v in zip(future, yhat, strict=True)]


def test_matches_direct_computation(spark):
    rng = np.random.default_rng(1)
    points = [(h * 12, 50 + 0.1 * h + 10 * math.sin(h * math.pi / 12) + float(rng.normal())) for h in range(24 * 6)]
    got = G.forecast(spark.createDataFrame(points, SERIES), 30).orderBy("tick").collect()
    assert [tuple(r) for r in got] == [pytest.approx(w) for w in brute_force(points, 30)]


def test_growth_continues_and_interval_is_ordered(spark):
    points = [(h * 12, 20 + 0.4 * (h // 24) + math.sin(h * math.pi / 12)) for h in range(24 * 14)]
    got = G.forecast(spark.createDataFrame(points, SERIES), 7 * 24).collect()
    assert max(r.yhat for r in got) > max(p[1] for p in points)
    assert all(r.yhat_lower <= r.yhat <= r.yhat_upper for r in got)


def test_short_series_is_flat(spark):
    got = G.forecast(spark.createDataFrame([(0, 10.0), (1, 11.0), (2, 12.0)], SERIES), 5).orderBy("tick").collect()
    assert [r.tick for r in got] == [3, 4, 5, 6, 7]
    assert all(r.yhat == 11.0 and r.yhat_upper == pytest.approx(12.28) for r in got)


def test_one_point_and_no_point(spark):
    one = G.forecast(spark.createDataFrame([(4, 10.0)], SERIES), 2).collect()
    assert [(r.tick, r.yhat_lower) for r in one] == [(5, pytest.approx(8.72)), (6, pytest.approx(8.72))]
    none = G.forecast(spark.createDataFrame([], SERIES), 2).orderBy("tick").collect()
    assert [tuple(r) for r in none] == [(1, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0)]


def test_series_per_key_are_independent(spark):
    rows = [(k, h * 12, b + h * 0.01) for k, b in (("a", 1.0), ("b", 100.0)) for h in range(72)]
    both = G.forecast(spark.createDataFrame(rows, "zone string, tick long, value double"), 12, by=["zone"])
    alone = G.forecast(spark.createDataFrame([r[1:] for r in rows if r[0] == "b"], SERIES), 12)
    got = [tuple(r)[1:] for r in both.filter("zone = 'b'").orderBy("tick").collect()]
    assert got == [pytest.approx(tuple(r)) for r in alone.orderBy("tick").collect()]


def test_threshold_crossing(spark):
    rows = [(t, 50.0 if t < 5 else 90.0) for t in range(10)]
    predicted = spark.createDataFrame(rows, "tick long, yhat double")
    assert G.threshold_crossing(predicted, 100.0, 0.85).first().ticks_to_threshold == 5
    flat = spark.createDataFrame([(t, 10.0) for t in range(10)], "tick long, yhat double")
    assert G.threshold_crossing(flat, 100.0).first().ticks_to_threshold is None


def test_weeks(spark):
    row = spark.range(1).select(G.weeks_of(F.lit(336)).alias("hours"), G.weeks_of(F.lit(4032), 12).alias("ticks")).first()
    assert (row.hours, row.ticks) == (2.0, 2.0)
