from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rackpulse.functions.windows import Hops, last_tick, to_windows
from rackpulse.operators import window_features as WF
from rackpulse.schemas import COUNTERS, METRICS, SIGNALS

HOPS = Hops.hours(lookback=24, horizon=12, step=6)
EVENTS = (
    "tick long, kind string, scope string, target string, severity string, benign boolean, parent_event_id string,"
    " node_id string, rack_id string, zone_id string"
)


def summary_by_hand(values):
    a = np.asarray(values, float)
    n = len(a)
    out = {"mean": a.mean(), "std": a.std(), "min": a.min(), "max": a.max(), "range": np.ptp(a), "last": a[-1]}
    out["slope"] = np.polyfit(np.arange(n), a, 1)[0] if n > 1 else 0.0
    if n > 1:
        x, y = a[:-1] - a[:-1].mean(), a[1:] - a[1:].mean()
        out["ac1"] = (x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum()) + 1e-12)
    else:
        out["ac1"] = 0.0
    out["spike_count"] = float((a > a.mean() + 2 * a.std() + 1e-9).sum())
    out["vol_max"] = float(pd.Series(a).rolling(max(3, n // 6)).std().max()) if n >= 6 else a.std()
    return out


@pytest.fixture(scope="module")
def samples():
    """Three GPUs of very different density, one of them with a counter reset and one constant."""
    rng = np.random.default_rng(5)
    rows = []
    for gpu, step in (("node-0000/gpu0", 1), ("node-0000/gpu1", 13), ("node-0003/gpu0", 97)):
        counter = np.zeros(3, int)
        for tick in range(0, 800, step):
            counter = counter + rng.integers(0, 3, 3)
            if step == 13 and tick == 390:
                counter[:] = 0
            level = [60.0, 200.0, 0.5] if step == 97 else [float(x) for x in rng.normal([60, 200, 0.5], [5, 20, 0.1])]
            rows.append((tick, gpu, gpu.split("/")[0], None, None, *level, *(int(c) for c in counter)))
    return rows


def test_gpu_statistics_equal_direct_computation(spark, samples):
    frame = pd.DataFrame(samples, columns=METRICS.names)
    metrics = spark.createDataFrame(samples, METRICS)
    got = {(r.gpu_id, r.window_end_tick): r.asDict() for r in WF.gpu_window_stats(metrics, HOPS).collect()}
    ends = range(HOPS.lookback, 799 - HOPS.horizon + 1, HOPS.step)
    expected = 0
    for end in ends:
        inside = frame[(frame.tick >= end - HOPS.lookback) & (frame.tick < end)]
        for gpu, part in inside.groupby("gpu_id"):
            expected += 1
            part = part.sort_values("tick")
            row = got[gpu, end]
            for counter in COUNTERS:
                part[counter.replace("_total", "_rate")] = part[counter].diff().fillna(0).clip(lower=0)
            for signal in SIGNALS:
                for stat, value in summary_by_hand(part[signal]).items():
                    if stat == "ac1" and np.ptp(part[signal]) < 1e-12:
                        continue
                    assert row[f"{signal}__{stat}"] == pytest.approx(value, rel=1e-6, abs=1e-7), (gpu, end, signal, stat)
    assert len(got) == expected


def test_chunk_length_does_not_change_the_result(spark, samples):
    metrics = spark.createDataFrame(samples, METRICS)
    plain = to_windows(metrics, HOPS, last_tick(metrics)).groupBy("gpu_id", "window_end_tick").count()
    stats = sorted(map(tuple, WF.gpu_window_stats(metrics, HOPS).collect()))
    assert len(stats) == plain.count()
    for size in (1, 2, 100):
        again = sorted(map(tuple, WF.gpu_window_stats(metrics, HOPS, windows_per_chunk=size).collect()))
        assert [r[:3] for r in again] == [r[:3] for r in stats]
        assert np.allclose([r[3:] for r in again], [r[3:] for r in stats])


def test_node_takes_the_worst_gpu(spark, samples):
    metrics = spark.createDataFrame(samples, METRICS)
    node = WF.node_window_stats(metrics, HOPS).filter("node_id = 'node-0000'").orderBy("window_end_tick").first()
    gpus = WF.gpu_window_stats(metrics, HOPS).filter(f"node_id = 'node-0000' and window_end_tick = {node.window_end_tick}")
    worst = gpus.agg(F.max("gpu_temp_c__min").alias("m")).first().m
    assert node.gpu_temp_c__min == worst


def events_of(spark, rows):
    full = [(t, k, "gpu", f"{n}/gpu0", s, s == "info", None, n, "rack-000", "zone-0") for t, k, s, n in rows]
    return spark.createDataFrame(full, EVENTS)


def test_label_only_for_the_doomed_node(spark, samples, fleet):
    events = events_of(spark, [(500, "ecc_uncorrectable", "critical", "node-0000"), (500, "cooling_failure", "critical", "node-0003")])
    dataset = WF.build_timeseries_dataset(spark.createDataFrame(samples, METRICS), events, fleet, HOPS)
    positive = {(r.node_id, r.window_end_tick) for r in dataset.filter(f"{WF.LABEL} = 1").collect()}
    assert positive == {("node-0000", e) for e in range(288, 656, 72) if e <= 500 < e + HOPS.horizon}
    assert set(WF.feature_columns(dataset.drop("first_event_tick"))) == set(WF.V2_FEATURES) and len(WF.V2_FEATURES) == 72
    assert dataset.filter("rack_id is null").count() == 0


def test_window_bounds_are_half_open(spark):
    hops = Hops(lookback=10, horizon=5, step=5)
    ticks = spark.createDataFrame([(t,) for t in range(0, 26)], "tick long")
    back = {(r.window_end_tick, r.tick) for r in to_windows(ticks, hops, last_tick(ticks)).collect()}
    ahead = {(r.window_end_tick, r.tick) for r in to_windows(ticks, hops, last_tick(ticks), ahead=True).collect()}
    ends = (10, 15, 20)
    assert back == {(e, t) for e in ends for t in range(e - 10, e)}
    assert ahead == {(e, t) for e in ends for t in range(e, e + 5)}


def test_history_too_short_gives_no_rows(spark, samples, fleet):
    metrics = spark.createDataFrame(samples, METRICS).filter("tick < 100")
    events = events_of(spark, [(50, "ecc_uncorrectable", "critical", "node-0000")])
    assert WF.build_timeseries_dataset(metrics, events, fleet, HOPS).count() == 0
    util = spark.createDataFrame([(12, "node-0000/gpu0", 0.5)], "tick long, gpu_id string, util double")
    assert WF.build_training_set(events, util, fleet, HOPS).count() == 0
    assert WF.build_training_set(events, util.filter("false"), fleet, HOPS).count() == 0


def test_counted_training_set(spark, fleet):
    rows = [(h * 12, "thermal_throttle", "warn", f"node-{n:04d}") for h in range(0, 72) for n in (0, 7)]
    rows += [(h * 12 + 72, "ecc_uncorrectable", "critical", "node-0007") for h in (20, 50)]
    util = spark.createDataFrame(
        [(h * 12, f"node-{n:04d}/gpu{g}", (h % 10) / 10) for h in range(80) for n in range(20) for g in range(2)],
        "tick long, gpu_id string, util double",
    )
    dataset = WF.build_training_set(events_of(spark, rows), util, fleet, HOPS)
    first = dataset.filter("window_end_tick = 288 and node_id = 'node-0007'").first()
    assert first.n_thermal_throttle == 24 and first.sev_warn == 24 and first.rack_thermal_stress == 0
    same_rack = dataset.filter("window_end_tick = 288 and node_id = 'node-0003'").first()
    assert same_rack.rack_id == "rack-000" and same_rack.rack_thermal_stress == 48 and same_rack.sev_warn == 0
    assert first.failed_next_24h == 1 and first.zone_events_in_window == 48
    assert first.util_mean == pytest.approx(np.mean([(h % 10) / 10 for h in range(24)]))
    assert first.util_std == pytest.approx(np.std([(h % 10) / 10 for h in range(24)], ddof=1))
    quiet = dataset.filter("window_end_tick = 288 and node_id = 'node-0012'").first()
    assert quiet.n_thermal_throttle == 0 and quiet.failed_next_24h == 0 and quiet.window_age_days == 1.0
    windows = dataset.select("window_end_tick").distinct().count()
    assert dataset.count() == windows * 20
    spread = {r.feature: r.kept for r in WF.feature_spread(dataset, list(WF.V1_FEATURES)).collect()}
    assert spread["n_thermal_throttle"] and not spread["n_psu_trip"]
    assert "n_psu_trip" not in WF.varying_columns(dataset, list(WF.V1_FEATURES))


def test_sequences(spark, samples):
    metrics = spark.createDataFrame(samples, METRICS)
    events = events_of(spark, [(500, "pcie_error", "critical", "node-0000")])
    made = WF.build_sequences(metrics, events, HOPS, samples=32).cache()
    rows = made.collect()
    assert {r.node_id for r in rows} == {"node-0000"} and all(len(r[s]) == 32 for r in rows for s in SIGNALS)
    first = min(rows, key=lambda r: r.window_end_tick)
    frame = pd.DataFrame(samples, columns=METRICS.names)
    part = frame[(frame.node_id == "node-0000") & (frame.tick < 288)].groupby("tick").gpu_temp_c.mean()
    places = np.linspace(0, len(part) - 1, 32).round().astype(int)
    assert first.gpu_temp_c == pytest.approx(part.to_numpy()[places].tolist())
    scaled = WF.scale_sequences(made, F.col("window_end_tick") < 400).filter("window_end_tick < 400").collect()
    values = np.concatenate([r.gpu_power_w for r in scaled])
    assert values.mean() == pytest.approx(0, abs=1e-9) and values.std() == pytest.approx(1)
