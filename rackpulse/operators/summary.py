"""Dashboard panels and the weekly KPI row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.functions.columns import floor_div, one_row, severity_rank
from rackpulse.operators import sla
from rackpulse.operators.energy import energy_summary, hourly_gpu_hours
from rackpulse.operators.forecast import forecast, headroom, threshold_crossing, weeks_of
from rackpulse.schemas import SEVERITIES


def kind_histogram(events: DataFrame) -> DataFrame:
    return events.groupBy("kind").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "kind")


def severity_domain_counts(events: DataFrame, incidents: DataFrame) -> DataFrame:
    """Raw events and incidents per severity over the fixed three-value domain, zero-filled."""

    def panel(df: DataFrame, column: str, name: str) -> DataFrame:
        counts = [F.count_if(F.col(column) == s) for s in SEVERITIES]
        rows = [F.struct(F.lit(s).alias("severity"), c.alias(name)) for s, c in zip(SEVERITIES, counts, strict=True)]
        return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))

    return panel(events, "severity", "raw").join(panel(incidents, "severity_max", "incidents"), "severity")


def top_incidents(incidents: DataFrame, n: int = 10) -> DataFrame:
    """Largest incidents; the sort keeps only n rows per task."""
    return incidents.orderBy(F.desc("member_count"), "opened_tick", "incident_id").limit(n).select(
        F.left("incident_id", F.lit(80)).alias("incident_id"),
        "root_kind", "scope", "member_count", "severity_max", "any_benign", "opened_tick", "duration_ticks",
    )


def activity_bins(events: DataFrame, bins: int = 48) -> DataFrame:
    """Severity-weighted activity over equal right-closed tick bins.

    The first tick lies on the open edge of the first bin, and ticks past the last whole bin have none; both are left
    out, as in the published panel.
    """
    span = one_row(events, lo=F.min("tick"), hi=F.max("tick"))
    weighted = events.groupBy("tick").agg(F.sum(severity_rank(F.col("severity")) + 1).alias("weight"))
    width = F.greatest(F.lit(1).cast("long"), floor_div(F.col("s.hi") - F.col("s.lo"), bins))
    return (
        weighted.withColumn("s", span)
        .withColumn("w", width)
        .withColumn("offset", F.col("tick") - F.col("s.lo"))
        .withColumn("bin", F.expr("(offset + w - 1) div w"))
        .filter("bin >= 1 and s.lo + bin * w <= s.hi")
        .groupBy(F.expr("cast(s.lo + (bin - 0.5) * w as bigint)").alias("tick"))
        .agg(F.sum("weight").alias("activity"))
    )


def dashboard_summary(events: DataFrame, deduped: DataFrame, incidents: DataFrame) -> dict[str, DataFrame]:
    """The panels as separate small frames."""
    totals = (
        events.agg(F.count("*").alias("raw_events"))
        .withColumn("deduped", deduped.agg(F.count("*")).scalar())
        .withColumn("incidents", incidents.agg(F.count("*")).scalar())
    )
    return {
        "event_kinds": kind_histogram(events),
        "severity": severity_domain_counts(events, incidents),
        "top_incidents": top_incidents(incidents),
        "activity_series": activity_bins(events),
        "totals": totals,
    }


def weekly_kpis(
    events: DataFrame,
    incidents: DataFrame,
    fleet: DataFrame,
    util: DataFrame,
    horizon_hours: int = 28 * 24,
    threshold: float = 0.70,
    gpus_per_node: int = 8,
) -> DataFrame:
    """Fourteen headline KPIs in one row, each branch reduced to a scalar before they meet."""
    hourly = hourly_gpu_hours(util)
    capacity = fleet.agg((F.countDistinct("node_id") * gpus_per_node).alias("capacity"))
    crossing = threshold_crossing(
        forecast(hourly, horizon_hours), capacity.scalar().cast("double"), threshold
    )
    energy = energy_summary(util)
    e = one_row(incidents, n=F.count("*"), critical=F.count_if(F.col("severity_max") == "critical"))
    raw = events.agg(F.count("*").alias("raw_events"), F.count_if("benign").alias("benign"))
    row = raw.withColumns(
        {
            "inc": e,
            "capacity": capacity.scalar(),
            "mean_hours": hourly.agg(F.avg("value")).scalar(),
            "crossing": crossing.select("ticks_to_threshold").scalar(),
            "energy": energy.select(F.struct("*")).scalar(),
        }
    )
    return row.select(
        "raw_events",
        F.col("inc.n").alias("incidents"),
        sla.alert_compression_ratio(F.col("raw_events"), F.col("inc.n")).alias("compression"),
        F.col("inc.critical").alias("critical"),
        sla.noise_rate(F.col("benign"), F.col("raw_events")).alias("noise_rate"),
        "capacity",
        headroom(F.coalesce("mean_hours", F.lit(0.0)), F.col("capacity")).alias("headroom"),
        weeks_of(F.col("crossing")).alias("weeks_to_threshold"),
        F.lit(horizon_hours).alias("horizon_hours"),
        F.col("energy.avg_fleet_kw").alias("avg_kw"),
        F.col("energy.total_kwh").alias("total_kwh"),
        F.col("energy.idle_kwh").alias("idle_kwh"),
        F.col("energy.idle_waste_dollars").alias("idle_dollars"),
        F.col("energy.perf_per_watt_tflops").alias("perf_w"),
    )
