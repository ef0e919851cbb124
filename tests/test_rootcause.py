from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from rackpulse.operators import clustering, families
from rackpulse.operators.incident_features import FEATURES, featurize
from rackpulse.schemas import INCIDENTS


@pytest.fixture(scope="module")
def two_families(spark):
    rows = []
    for day in range(30):
        morning, afternoon = day * 288 + 8 * 12, day * 288 + 15 * 12
        rows.append((f"m{day}", morning, morning + 2, 10, "thermal_throttle", "gpu", "info", True, True, 2))
        rows.append((f"a{day}", afternoon, afternoon + 9, 100, "nvlink_fault", "node", "critical", False, False, 9))
    rows.append(("odd", 5, 5, 1, "psu_trip", "rack", "warn", False, False, 0))
    return spark.createDataFrame(rows, INCIDENTS)


def test_features(two_families):
    rows = featurize(two_families).collect()
    assert len(rows) == 61 and len(FEATURES) == 20
    first = next(r for r in rows if r.incident_id == "m0")
    assert first.kind_thermal_throttle == 1.0 and first.scope_gpu == 1.0 and first.severity == 0.0
    assert first.log_member_count == pytest.approx(math.log(11))
    assert first.hod_sin == pytest.approx(math.sin(2 * math.pi * 8 / 24))
    hot = [c for c in FEATURES if c.startswith(("kind_", "scope_"))]
    assert all(sum(r[c] for c in hot) == 2.0 for r in rows)


def test_groups_land_in_disjoint_families(two_families):
    rows = clustering.cluster_incidents(two_families, min_cluster_size=5).collect()
    morning = {r.cluster_id for r in rows if r.incident_id.startswith("m")}
    afternoon = {r.cluster_id for r in rows if r.incident_id.startswith("a")}
    assert len(morning) == len(afternoon) == 1 and morning.isdisjoint(afternoon) and -1 not in morning | afternoon
    odd = next(r for r in rows if r.incident_id == "odd")
    assert (odd.cluster_id, odd.cluster_label) == (-1, families.NOISE_LABEL)
    label = next(r.cluster_label for r in rows if r.incident_id == "m0")
    assert label == "thermal_throttle · gpu · info · ~08:00 (30×)"


def test_small_groups_are_noise(two_families):
    assert clustering.density_clusters(two_families, min_cluster_size=31).filter("cluster_id <> -1").count() == 0


def test_radius_must_stay_below_one_step(two_families):
    with pytest.raises(ValueError):
        clustering.density_clusters(two_families, eps=1.5)


def test_ranking_and_quality(two_families):
    clustered = clustering.cluster_incidents(two_families, 5).cache()
    top = families.top_recurring(clustered, 1).collect()
    assert len(top) == 1 and top[0]["count"] == 30 and top[0].cluster_id == 0
    assert families.cluster_counts(clustered).first().asDict() == {"clusters": 2, "noise": 1, "incidents": 61}
    assert clustering.silhouette(clustered).first().silhouette == pytest.approx(1.0)
    one = clustered.withColumn("cluster_id", F.lit(0))
    assert clustering.silhouette(one).first().silhouette is None


def test_centroid_families(two_families):
    rows = clustering.kmeans_clusters(two_families, k=3).collect()
    by = {}
    for r in rows:
        by.setdefault(r.incident_id[0], set()).add(r.cluster_id)
    assert len(by["m"]) == len(by["a"]) == 1 and by["m"].isdisjoint(by["a"])
