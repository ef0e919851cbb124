"""Service-level KPIs as column expressions, and their ticket aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackpulse.functions.columns import ratio

INFINITY = float("inf")


def availability(node_hours: Column, downtime_hours: Column) -> Column:
    return F.greatest(F.lit(0.0), ratio(node_hours - downtime_hours, node_hours))


def mtbf(operating_hours: Column, failures: Column) -> Column:
    return ratio(operating_hours, failures, when_zero=INFINITY)


def incident_rate(incidents: Column, node_hours: Column) -> Column:
    """Incidents per 1,000 node-hours."""
    return ratio(F.lit(1000.0) * incidents, node_hours)


def alert_compression_ratio(raw_alerts: Column, incidents: Column) -> Column:
    return ratio(raw_alerts, incidents, when_zero=INFINITY)


def noise_rate(benign: Column, total: Column) -> Column:
    return ratio(benign, total)


def hours_between(start: Column, end: Column) -> Column:
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return micros / F.lit(3_600_000_000.0)


def mttr() -> Column:
    """Mean hours from opening to resolution; 0 without resolved tickets."""
    return F.coalesce(F.avg(hours_between(F.col("opened_at"), F.col("resolved_at"))), F.lit(0.0))


def mttd() -> Column:
    """Mean hours from the event to the opening; 0 without tickets."""
    return F.coalesce(F.avg(hours_between(F.col("event_at"), F.col("opened_at"))), F.lit(0.0))


def first_time_resolution() -> Column:
    resolved = F.count("resolved_at")
    return ratio(resolved - F.count_if("reopened"), resolved)


def ticket_kpis(tickets: DataFrame, *by: str) -> DataFrame:
    """Ticket count, MTTR, MTTD and first-time resolution for all tickets or per key."""
    return tickets.groupBy(*by).agg(
        F.count("*").alias("tickets"),
        mttr().alias("mttr_hours"),
        mttd().alias("mttd_hours"),
        first_time_resolution().alias("first_time_resolution"),
    )
