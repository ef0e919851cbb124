from __future__ import annotations

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from rackpulse.schemas import EVENTS, METRICS, STAR
from rackpulse.sources import exporter, matrix, otlp, star_files, tables


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_listing(spark, tmp_path):
    text = """#Entity   GPUTL POWER GTEMP ECCAR NVLBE PCIRX

GPU-Id header
GPU 0       91   655    80     4    27    8
gpu 1\t12  208.25  47   9  33
GPU 2       55   N/A    70     6    19    3
GPU 3       74   502    66     1.5    40    2
SWITCH 3    20   310    51     7    22    1
GPU 4 6 9
"""
    rows = exporter.read_exporter(spark, write(tmp_path, "dmon.txt", text)).orderBy("gpu_id").collect()
    assert [r.gpu_id for r in rows] == ["node-unknown/gpu0", "node-unknown/gpu1"]
    assert (rows[0].gpu_sm_util, rows[0].gpu_temp_c, rows[0].gpu_power_w) == (0.91, 80.0, 655.0)
    assert (rows[0].pcie_aer_total, rows[1].pcie_aer_total, rows[0].tick, rows[0].rack_id) == (8, 0, 0, None)
    assert [f.name for f in exporter.read_exporter(spark, write(tmp_path, "e.txt", "\n")).schema] == METRICS.names


def test_exporter_csv(spark, tmp_path, fleet):
    text = """timestamp,Hostname,GPU-Id,DCGM_FI_DEV_GPU_TEMP,DCGM_FI_DEV_POWER_USAGE,DCGM_FI_DEV_GPU_UTIL,DCGM_FI_DEV_ECC_SBE_VOL_TOTAL
2026-05-01 00:00:00,node-0001,0,61,170.5,42,3
2026-05-01 00:05:00,node-0001,0,62,171.0,80,4
2026-05-01 00:12:29,node-0009,1,60,169.0,38,
"""
    path = write(tmp_path, "x.csv", text)
    rows = exporter.read_exporter(spark, path, fleet).orderBy("tick").collect()
    assert [(r.tick, r.gpu_id, r.rack_id, r.zone_id) for r in rows] == [
        (0, "node-0001/gpu0", "rack-000", "zone-0"), (1, "node-0001/gpu0", "rack-000", "zone-0"),
        (2, "node-0009/gpu1", "rack-001", "zone-1"),
    ]
    assert [r.gpu_sm_util for r in rows] == [0.42, 0.8, 0.38]
    assert rows[2].ecc_corrected_total is None and rows[0].nvlink_crc_total == 0
    later = exporter.read_exporter(spark, path, origin=F.lit(1777593600 - 300)).agg(F.min("tick")).first()[0]
    assert later == 1


def payload(series, status="success"):
    return {"status": status, "error": "boom", "data": {"result": series}}


def series(name, values, **labels):
    return {"metric": {"__name__": name, **labels}, "values": values}


def test_range_query(spark, tmp_path):
    body = payload([
        series("DCGM_FI_DEV_GPU_TEMP", [[1000, "62.3"], [1300, "63.0"], [1300, "64.0"], [1600, "bad"]], hostname="n1", gpu="0"),
        series("DCGM_FI_DEV_POWER_USAGE", [[1000, "180"], [1300, "182.5"]], Hostname="n1", **{"GPU-Id": "0"}),
        series("DCGM_FI_DEV_GPU_UTIL", [[1300, "55"]], hostname="", instance="n1", gpu="0"),
        series("other", [[1000, "1"]], hostname="n1", gpu="0"),
    ])
    rows = matrix.read_range_query(spark, write(tmp_path, "m.json", json.dumps(body, indent=1))).orderBy("tick").collect()
    assert [(r.tick, r.gpu_id, r.gpu_temp_c, r.gpu_power_w) for r in rows] == [
        (0, "n1/gpu0", 62.3, 180.0), (1, "n1/gpu0", 64.0, 182.5)
    ]
    assert (rows[0].gpu_sm_util, rows[1].gpu_sm_util, rows[0].ecc_corrected_total) == (None, 0.55, 0)


def test_range_query_empty_and_failed(spark):
    empty = spark.createDataFrame([(json.dumps(payload([])),)], "value string")
    assert matrix.parse_range_query(empty).count() == 0 and matrix.parse_range_query(empty).columns == METRICS.names
    failed = spark.createDataFrame([(json.dumps(payload([], "error")),)], "value string")
    with pytest.raises(Exception, match="boom"):
        matrix.parse_range_query(failed).collect()


def test_otlp(spark):
    def point(gpu, ns, **value):
        return {"attributes": [{"key": "gpu.id", "value": gpu}], "timeUnixNano": str(ns), **value}

    body = {
        "resourceMetrics": [{
            "resource": {"attributes": [{"key": "host.name", "value": {"stringValue": "node-0042"}}]},
            "scopeMetrics": [{"metrics": [
                {"name": "gpu.temperature", "gauge": {"dataPoints": [
                    point({"intValue": "3"}, 0, asDouble=71.5), point({"stringValue": "3"}, 300 * 10**9, asInt="72"),
                    point({"intValue": 3}, 600 * 10**9)]}},
                {"name": "gpu.memory.ecc.errors.corrected", "sum": {"dataPoints": [point({"intValue": "3"}, 0, asInt="9")]}},
                {"name": "unknown", "gauge": {"dataPoints": [point({"intValue": "3"}, 0, asDouble=1)]}},
            ]}],
        }, {"scopeMetrics": [{"metrics": [{"name": "gpu.power.draw", "gauge": {"dataPoints": [{"timeUnixNano": "0", "asDouble": 5}]}}]}]}]
    }
    rows = otlp.parse_otlp(spark.createDataFrame([(json.dumps(body),)], "value string")).orderBy("gpu_id", "tick").collect()
    assert [(r.gpu_id, r.tick, r.gpu_temp_c, r.gpu_power_w, r.ecc_corrected_total) for r in rows] == [
        ("node-0042/gpu3", 0, 71.5, None, 9), ("node-0042/gpu3", 1, 72.0, None, None), ("node-unknown/gpu0", 0, None, 5.0, None),
    ]


def test_attributes_keep_the_last_of_a_key(spark):
    kinds = "array<struct<key string, value struct<stringValue string, intValue string, doubleValue string, boolValue string>>>"
    df = spark.createDataFrame([([("a", ("x", "1", None, None)), ("b", (None, None, None, "true")), ("a", (None, "2", None, None))],)],
                               f"attrs {kinds}")
    assert df.select(otlp.attribute_map(F.col("attrs")).alias("m")).first().m == {"a": "2", "b": "true"}


def test_tables(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([(1, "k", "gpu", "t", "info", True, None)], EVENTS).write.parquet(f"{root}/events.parquet")
    assert tables.load(spark, root, "events").schema == EVENTS
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        tables.load(spark, root, "metrics").count()


def test_metrics_are_stored_by_day(spark, tmp_path):
    rows = [(t, "node-0000/gpu0", "node-0000", None, None, 1.0, 2.0, 0.5, 0, 0, 0) for t in (0, 287, 288, 900)]
    tables.write_metrics(spark.createDataFrame(rows, METRICS), f"{tmp_path}/m")
    back = spark.read.parquet(f"{tmp_path}/m")
    assert sorted(r.day for r in back.collect()) == [0, 0, 1, 3]


def test_latest_window_and_results(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "window_end_tick long, node_id string")
    tables.write_latest_window(df, f"{tmp_path}/w")
    assert {r.node_id for r in spark.read.parquet(f"{tmp_path}/w").collect()} == {"b", "c"}
    tables.write_result(df, f"{tmp_path}/r")
    tables.write_result(df, f"{tmp_path}/j", "json")
    assert spark.read.option("header", True).csv(f"{tmp_path}/r").count() == spark.read.json(f"{tmp_path}/j").count() == 3


def test_scoring_input_fills_and_orders(spark):
    df = spark.createDataFrame([("n", None, 3, 9)], "node_id string, a double, b int, extra int")
    assert tables.scoring_input(df, ["b", "missing", "a"], ("node_id",)).first() == ("n", 3.0, 0.0, 0.0)


def test_star_round_trip_keeps_rows_and_types(spark, tmp_path):
    from datetime import date, datetime

    made = {
        "fact_events": [(1, "k", "gpu", 'a "quoted", target', "info", True, None, None, "", None, None, None)],
        "fact_incidents": [("i", 1, 2, 2, "k", "gpu", "warn", False, True, 1, -1, "noise / unclustered")],
        "fact_hourly_kpi": [(12, 1.5, 3, 2.25, 0)],
        "fact_clusters": [(0, "k · gpu · info · ~08:00 (3×)", 3, 0, 1 / 3, 2.0)],
        "dim_fleet": [("node-0000", "rack-000", "zone-0", "zone-0/feed-0", "spine-0")],
        "dim_time": [(0, datetime(2026, 5, 1), date(2026, 5, 1), 0, "Friday", False)],
    }
    frames = {name: spark.createDataFrame(rows, STAR[name]) for name, rows in made.items()}
    root = star_files.export(spark, frames, f"{tmp_path}/star")
    for name, df in star_files.read_csv_star(spark, root).items():
        assert df.schema == STAR[name] and df.collect() == frames[name].collect(), name
    assert spark.read.json(f"{root}/relationships.json").count() == 4
    write(tmp_path, "star/broken.csv", "tick,fleet_kw,active_gpu_count,gpu_hours,idle_gpu_count\nx,1,1,1,1\n")
    with pytest.raises(Exception, match="MALFORMED"):
        star_files.read_csv(spark, f"{root}/broken.csv", "fact_hourly_kpi").collect()
