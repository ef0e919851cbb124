from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from rackpulse.operators import energy, sla, star, summary
from rackpulse.operators.forecast import headroom


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


@pytest.mark.parametrize(
    ("expr", "expected"),
    [
        (lambda: sla.availability(F.lit(1000.0), F.lit(0.0)), 1.0),
        (lambda: sla.availability(F.lit(1000.0), F.lit(100.0)), 0.9),
        (lambda: sla.availability(F.lit(0.0), F.lit(0.0)), 0.0),
        (lambda: sla.availability(F.lit(10.0), F.lit(20.0)), 0.0),
        (lambda: sla.mtbf(F.lit(1000.0), F.lit(10)), 100.0),
        (lambda: sla.mtbf(F.lit(1000.0), F.lit(0)), math.inf),
        (lambda: sla.incident_rate(F.lit(5), F.lit(1000.0)), 5.0),
        (lambda: sla.alert_compression_ratio(F.lit(1000), F.lit(100)), 10.0),
        (lambda: sla.alert_compression_ratio(F.lit(1000), F.lit(0)), math.inf),
        (lambda: sla.noise_rate(F.lit(70), F.lit(100)), 0.7),
        (lambda: sla.noise_rate(F.lit(0), F.lit(0)), 0.0),
        (lambda: headroom(F.lit(0.0), F.lit(100.0)), 1.0),
        (lambda: headroom(F.lit(50.0), F.lit(100.0)), 0.5),
        (lambda: headroom(F.lit(150.0), F.lit(100.0)), 0.0),
        (lambda: headroom(F.lit(50.0), F.lit(0.0)), 0.0),
        (lambda: energy.pue(F.lit(120.0), F.lit(100.0)), 1.2),
        (lambda: energy.pue(F.lit(120.0), F.lit(0.0)), 0.0),
        (lambda: energy.renewable_match(F.lit(300.0), F.lit(100.0)), 1.0),
        (lambda: energy.renewable_match(F.lit(30.0), F.lit(0.0)), 0.0),
    ],
)
def test_scalars(spark, expr, expected):
    assert value(spark, expr()) == pytest.approx(expected)


def test_ticket_kpis(spark):
    df = spark.sql(
        "select * from values"
        " (timestamp'2024-01-01 00:00:00', timestamp'2024-01-01 01:00:00', timestamp'2024-01-01 05:00:00', true),"
        " (timestamp'2024-01-01 00:00:00', timestamp'2024-01-01 00:30:00', timestamp'2024-01-01 02:30:00', false),"
        " (timestamp'2024-01-01 00:00:00', timestamp'2024-01-01 00:30:00', null, false)"
        " as t(event_at, opened_at, resolved_at, reopened)"
    )
    row = sla.ticket_kpis(df).first()
    assert (row.tickets, row.mttr_hours, row.first_time_resolution) == (3, 3.0, 0.5)
    assert row.mttd_hours == pytest.approx(2 / 3)
    none = sla.ticket_kpis(df.filter("false")).first()
    assert (none.mttr_hours, none.mttd_hours, none.first_time_resolution) == (0.0, 0.0, 0.0)


def util(spark, rows):
    return spark.createDataFrame(rows, "tick long, gpu_id string, util double")


def test_power_of_two_nodes(spark):
    rows = [(t, f"node-000{g // 8}/gpu{g % 8}", 0.5 if g % 2 else 0.0) for t in (0, 12) for g in range(16)]
    series = energy.power_timeseries(util(spark, rows)).orderBy("tick").collect()
    assert [r.tick for r in series] == [0, 12]
    assert series[0].fleet_kw == pytest.approx((16 * 210 + 8 * 0.5 * 490 + 2 * 600) / 1000)
    assert series[0].active_gpu_count == 8
    row = energy.energy_summary(util(spark, rows)).first()
    assert len(row) == 7 and row.idle_kwh == pytest.approx(16 * 0.21)
    assert row.total_gpu_hours == pytest.approx(8.0)


def test_idle_energy(spark):
    df = util(spark, [(0, f"node-0000/gpu{i}", u) for i, u in enumerate((0.0, 0.5, 0.02, 0.9))])
    assert energy.energy_summary(df).first().idle_kwh == pytest.approx(0.42)
    watts = energy.node_power(df).first().watts
    assert watts == pytest.approx(600 + 4 * 210 + 490 * 1.42)


def test_empty_utilisation_has_no_summary(spark):
    assert energy.energy_summary(util(spark, [])).count() == 0


def test_severity_domain_is_complete(spark):
    events = spark.createDataFrame([("info",), ("info",), ("odd",)], "severity string")
    incidents = spark.createDataFrame([("critical",)], "severity_max string")
    got = {r.severity: (r.raw, r.incidents) for r in summary.severity_domain_counts(events, incidents).collect()}
    assert got == {"info": (2, 0), "warn": (0, 0), "critical": (0, 1)}


def test_activity_bins_leave_out_the_open_edge_and_the_tail(spark):
    events = spark.createDataFrame([(t, "info") for t in range(0, 101)], "tick long, severity string")
    bins = {r.tick: r.activity for r in summary.activity_bins(events).collect()}
    # Width 2: right-closed bins (0, 2], (2, 4], ... (98, 100]; tick 0 has none.
    assert bins[1] == 2 and sum(bins.values()) == 100 and len(bins) == 50


def test_calendar(spark):
    ticks = spark.createDataFrame([(300,)], "tick long")
    rows = star.dim_time(ticks).orderBy("tick").collect()
    assert len(rows) == 301
    assert (rows[0].day_of_week, rows[0].is_weekend, rows[0].hour) == ("Friday", False, 0)
    assert (rows[288].day_of_week, rows[288].is_weekend, str(rows[288].date)) == ("Saturday", True, "2026-05-02")


def test_star_orphans(spark, fleet):
    tables = {
        "fact_events": spark.createDataFrame([("node-0001", 1), ("ghost", 99), (None, 1)], "node_id string, tick long"),
        "dim_fleet": fleet,
        "dim_time": spark.range(10).withColumnRenamed("id", "tick"),
        "fact_hourly_kpi": spark.createDataFrame([(3,)], "tick long"),
        "fact_incidents": spark.createDataFrame([(0,), (1,), (1,)], "cluster_id long"),
        "fact_clusters": spark.createDataFrame([(0,)], "cluster_id long"),
    }
    got = {r.left: (r.orphan_keys, r.orphan_rows) for r in star.orphans(tables).collect()}
    assert got == {
        "fact_events.node_id": (1, 1), "fact_events.tick": (1, 1), "fact_hourly_kpi.tick": (0, 0),
        "fact_incidents.cluster_id": (1, 2),
    }
