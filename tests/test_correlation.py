from __future__ import annotations

import random

from pyspark.sql import functions as F

from rackpulse.operators import correlation as C
from rackpulse.operators.topology import build_fleet, enrich_with_topology, fleet_slice, gpus_by, place_nodes

BARE = "tick long, kind string, target string, severity string"
ENRICHED = (
    "tick long, kind string, scope string, target string, severity string, benign boolean, parent_event_id string,"
    " rack_id string, zone_id string, feed_id string, spine_id string"
)


def brute_force(rows, window):
    """Ids kept by walking each key in (tick, id) order."""
    last, kept = {}, set()
    for event_id, tick, kind, target, severity in sorted(rows, key=lambda r: (r[1], r[0])):
        key = (kind, target)
        if key not in last or tick - last[key] > window or severity == "critical":
            kept.add(event_id)
            last[key] = tick
    return kept


def test_flapping_keeps_first_and_late(spark):
    rows = [(t, "thermal_throttle", "node-0001/gpu0", "info") for t in (0, 1, 2, 50)]
    kept = C.dedupe(spark.createDataFrame(rows, BARE), 5)
    assert sorted(r.tick for r in kept.collect()) == [0, 50]


def test_critical_is_always_kept(spark):
    rows = [(0, "k", "t", "info"), (1, "k", "t", "critical")]
    assert C.dedupe(spark.createDataFrame(rows, BARE), 10).count() == 2


def test_dedupe_equals_walking_the_rows(spark):
    rng = random.Random(7)
    rows = [
        (i, rng.randint(0, 120), rng.choice("ab"), f"t{rng.randint(0, 9)}", rng.choices(
            ["info", "warn", "critical"], [6, 3, 1])[0])
        for i in range(3000)
    ]
    # One key holds a third of all rows, with long unbroken runs.
    rows += [(10_000 + i, rng.randint(0, 400), "hot", "hot", "info") for i in range(1500)]
    df = spark.createDataFrame(rows, "event_id long, tick long, kind string, target string, severity string")
    for window in (0, 1, 5, 40):
        got = {r.event_id for r in C.dedupe(df, window).select("event_id").collect()}
        assert got == brute_force(rows, window), window


def test_dedupe_of_nothing_keeps_the_schema(spark):
    empty = spark.createDataFrame([], BARE)
    assert C.dedupe(empty).columns == ["tick", "kind", "target", "severity"]
    assert C.dedupe(empty).count() == 0


def test_cascade_joins_children_of_one_parent(spark):
    rows = [
        (t, "thermal_throttle", "node", f"node-000{t}", "warn", False, "p1", "rack-000", "zone-0", "f", "s") for t in (1, 2)
    ]
    incident = C.correlate(spark.createDataFrame(rows, ENRICHED)).collect()
    assert [(i.incident_id, i.member_count, i.severity_max) for i in incident] == [("cascade:p1", 2, "warn")]


def test_rack_burst_is_one_incident(spark):
    rows = [
        (t, "thermal_throttle", "gpu", f"node-0001/gpu{t}", "info", True, None, "rack-000", "zone-0", "f", "s")
        for t in range(5)
    ]
    incident = C.correlate(spark.createDataFrame(rows, ENRICHED), 10).first()
    assert incident.member_count == 5 and incident.duration_ticks == 4 and incident.all_benign


def test_solo_and_missing_topology(spark):
    rows = [
        (1, "power_event", "feed", "zone-0/feed-1", "critical", False, None, None, None, None, None),
        (16, "power_event", "feed", "zone-0/feed-1", "info", True, None, None, None, None, None),
    ]
    ids = {r.incident_id for r in C.correlate(spark.createDataFrame(rows, ENRICHED), 15).collect()}
    assert ids == {"burst:power_event|solo=zone-0/feed-1|t0", "burst:power_event|solo=zone-0/feed-1|t1"}


def test_enrichment_places_gpus_and_zones(spark, fleet):
    rows = [
        (0, "k", "gpu", "node-0007/gpu3", "info", True, None),
        (0, "k", "zone", "zone-9", "info", True, None),
        (0, "k", "rack", "rack-001", "info", True, None),
        (0, "k", "node", "node-9999", "info", True, None),
    ]
    events = spark.createDataFrame(
        rows, "tick long, kind string, scope string, target string, severity string, benign boolean, parent_event_id string"
    )
    got = {r.target: (r.node_id, r.rack_id, r.zone_id) for r in enrich_with_topology(events, fleet).collect()}
    assert got == {
        "node-0007/gpu3": ("node-0007", "rack-001", "zone-0"),
        "zone-9": (None, None, "zone-9"),
        "rack-001": (None, None, None),
        "node-9999": ("node-9999", None, None),
    }


def test_severity_of_a_group_without_any(spark):
    row = spark.createDataFrame([(None,), (None,)], "s string").agg(C.max_severity(F.col("s")).alias("m")).first()
    assert row.m == "info"


def test_repeat_openings(spark):
    rows = [("a", 0, "k", "node", "warn"), ("b", 3, "k", "node", "warn"), ("c", 50, "k", "node", "warn"),
            ("d", 50, "k", "node", "warn"), ("e", 0, "x", "node", "warn")]
    incidents = spark.createDataFrame(rows, "incident_id string, opened_tick long, root_kind string, scope string, severity_max string")
    got = {r.incident_id: r.reopened for r in C.repeat_openings(incidents, 3).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": True, "e": False}


def test_default_fleet_shape(spark):
    fleet = build_fleet(spark)
    assert fleet.count() == 500
    assert gpus_by(fleet).first().total_gpus == 4000
    assert fleet.select("rack_id").distinct().count() == 100
    assert fleet.select("zone_id").distinct().count() == 5
    assert fleet_slice(fleet, zone="zone-0").count() == 100
    assert fleet_slice(fleet, feed="zone-0/feed-1", rack="rack-001").count() == 5


def test_long_ordinals_keep_their_digits(spark):
    ids = spark.createDataFrame([(12345,), (7,)], "n long")
    assert {r.node_id for r in place_nodes(ids, "n").collect()} == {"node-12345", "node-0007"}
