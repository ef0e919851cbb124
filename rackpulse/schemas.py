"""Declared table schemas and the fixed vocabularies of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Event kinds, scopes, severities and topology keys, in their published order.
KINDS = (
    "thermal_throttle",
    "ecc_uncorrectable",
    "nvlink_fault",
    "pcie_error",
    "network_flap",
    "psu_trip",
    "power_event",
    "cooling_failure",
)
SCOPES = ("gpu", "node", "rack", "zone", "feed", "spine")
SEVERITIES = ("info", "warn", "critical")
TOPOLOGY = ("rack_id", "zone_id", "feed_id", "spine_id")
COMPONENT_KINDS = ("ecc_uncorrectable", "nvlink_fault", "pcie_error")
PRECURSOR_KINDS = ("ecc_uncorrectable", "nvlink_fault", "pcie_error", "thermal_throttle")

# Sampled levels and monotone counters of the metrics table.
LEVELS = ("gpu_temp_c", "gpu_power_w", "gpu_sm_util")
COUNTERS = ("ecc_corrected_total", "nvlink_crc_total", "pcie_aer_total")
RATES = ("ecc_corrected_rate", "nvlink_crc_rate", "pcie_aer_rate")
SIGNALS = LEVELS + RATES
STATS = ("mean", "std", "min", "max", "range", "slope", "ac1", "spike_count", "last", "vol_max")

TICKS_PER_HOUR = 12
SECONDS_PER_TICK = 300


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_L, _D, _S, _B = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()

EVENTS = _struct(tick=_L, kind=_S, scope=_S, target=_S, severity=_S, benign=_B, parent_event_id=_S)
FLEET = _struct(node_id=_S, rack_id=_S, zone_id=_S, feed_id=_S, spine_id=_S)
UTILIZATION = _struct(tick=_L, gpu_id=_S, util=_D)
METRICS = _struct(
    tick=_L, gpu_id=_S, node_id=_S, rack_id=_S, zone_id=_S,
    gpu_temp_c=_D, gpu_power_w=_D, gpu_sm_util=_D,
    ecc_corrected_total=_L, nvlink_crc_total=_L, pcie_aer_total=_L,
)
ENRICHED = _struct(
    tick=_L, kind=_S, scope=_S, target=_S, severity=_S, benign=_B, parent_event_id=_S,
    node_id=_S, rack_id=_S, zone_id=_S, feed_id=_S, spine_id=_S,
)
INCIDENTS = _struct(
    incident_id=_S, opened_tick=_L, resolved_tick=_L, member_count=_L, root_kind=_S, scope=_S,
    severity_max=_S, all_benign=_B, any_benign=_B, duration_ticks=_L,
)
CLUSTERED = T.StructType(INCIDENTS.fields + _struct(cluster_id=_L, cluster_label=_S).fields)
CLUSTERS = _struct(
    cluster_id=_L, cluster_label=_S, count=_L, critical_count=_L, all_benign_ratio=_D, mean_members=_D,
)
HOURLY_KPI = _struct(tick=_L, fleet_kw=_D, active_gpu_count=_L, gpu_hours=_D, idle_gpu_count=_L)
DIM_TIME = _struct(
    tick=_L, datetime=T.TimestampType(), date=T.DateType(), hour=T.IntegerType(), day_of_week=_S, is_weekend=_B,
)

STAR = {
    "fact_events": ENRICHED,
    "fact_incidents": CLUSTERED,
    "fact_hourly_kpi": HOURLY_KPI,
    "fact_clusters": CLUSTERS,
    "dim_fleet": FLEET,
    "dim_time": DIM_TIME,
}
