"""Star schema over incidents, events and hourly KPIs, and the measures defined on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackpulse.functions.columns import count_where, ratio
from rackpulse.operators.energy import GPU_PEAK_TFLOPS, PRICE_PER_KWH, hourly_kpi
from rackpulse.operators.families import top_recurring
from rackpulse.schemas import STAR, TICKS_PER_HOUR

# Calendar origin of the time dimension, energy of one idle GPU-hour.
CALENDAR_ORIGIN = "2026-05-01 00:00:00"
IDLE_KWH_PER_GPU_HOUR = 0.21

RELATIONSHIPS = (
    ("fact_events", "node_id", "dim_fleet", "node_id"),
    ("fact_events", "tick", "dim_time", "tick"),
    ("fact_hourly_kpi", "tick", "dim_time", "tick"),
    ("fact_incidents", "cluster_id", "fact_clusters", "cluster_id"),
)


def dim_time(
    *tables: DataFrame, ticks_per_hour: int = TICKS_PER_HOUR, origin: str = CALENDAR_ORIGIN
) -> DataFrame:
    """One row per tick from 0 to the last tick of the given tables; its length is bounded by time, not by rows."""
    tops = [t.agg(F.max("tick").alias("top")) for t in tables]
    merged = tops[0]
    for top in tops[1:]:
        merged = merged.unionByName(top)
    start = F.unix_timestamp(F.lit(origin).cast("timestamp"))
    micros = start * 1_000_000 + F.round(F.col("tick") * (3_600_000_000 / ticks_per_hour)).cast("long")
    return (
        merged.agg(F.max("top").alias("top"))
        .filter("top is not null")
        .select(F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("tick"))
        .withColumn("datetime", F.timestamp_micros(micros))
        .select(
            "tick",
            "datetime",
            F.to_date("datetime").alias("date"),
            F.hour("datetime").alias("hour"),
            F.date_format("datetime", "EEEE").alias("day_of_week"),
            (F.weekday("datetime") >= 5).alias("is_weekend"),
        )
    )


def star_schema(
    enriched: DataFrame, clustered: DataFrame, util: DataFrame, fleet: DataFrame, families: int = 50
) -> dict[str, DataFrame]:
    """The six tables, in their declared column order."""
    tables = {
        "fact_events": enriched,
        "fact_incidents": clustered,
        "fact_hourly_kpi": hourly_kpi(util),
        "fact_clusters": top_recurring(clustered, families),
        "dim_fleet": fleet,
        "dim_time": dim_time(enriched, util),
    }
    return {
        name: df.select(*[F.col(f.name).cast(f.dataType) for f in STAR[name].fields]) for name, df in tables.items()
    }


def orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """Fact keys without a dimension row, per relationship; null keys and noise are not references."""
    checks = []
    for fact, key, dimension, other in RELATIONSHIPS:
        keys = tables[fact].groupBy(F.col(key).alias("k")).agg(F.count("*").alias("rows")).filter("k is not null")
        missing = keys.join(tables[dimension].select(F.col(other).alias("k")), "k", "left_anti")
        checks.append(
            missing.agg(F.count("*").alias("orphan_keys"), F.coalesce(F.sum("rows"), F.lit(0)).alias("orphan_rows"))
            .select(
                F.lit(f"{fact}.{key}").alias("left"), F.lit(f"{dimension}.{other}").alias("right"),
                "orphan_keys", "orphan_rows",
            )
        )
    merged = checks[0]
    for check in checks[1:]:
        merged = merged.unionByName(check)
    return merged


def event_measures() -> dict[str, Column]:
    return {
        "total_events": F.count("*"),
        "noise_rate": ratio(count_where(F.col("benign")), F.count("*")),
        "distinct_ticks": F.countDistinct("tick"),
    }


def incident_measures(ticks_per_hour: int = TICKS_PER_HOUR) -> dict[str, Column]:
    return {
        "total_incidents": F.count("*"),
        "critical_incidents": F.count_if(F.col("severity_max") == "critical"),
        "mttr_hours": F.avg(F.col("duration_ticks") / ticks_per_hour),
    }


def kpi_measures() -> dict[str, Column]:
    energy, tflops, idle = F.sum("fleet_kw"), F.sum(F.col("gpu_hours") * GPU_PEAK_TFLOPS), F.sum("idle_gpu_count")
    return {
        "total_energy_kwh": energy,
        "aggregate_tflops": tflops,
        "perf_per_watt": F.try_divide(tflops, energy * 1000),
        "avg_fleet_kw": F.avg("fleet_kw"),
        "idle_gpu_hours": idle,
        "idle_energy_kwh": idle * IDLE_KWH_PER_GPU_HOUR,
        "idle_cost": idle * IDLE_KWH_PER_GPU_HOUR * PRICE_PER_KWH,
        "gpu_hours": F.sum("gpu_hours"),
        "hours": F.count("*"),
    }


def aggregate(df: DataFrame, measures: dict[str, Column], *by: str) -> DataFrame:
    """Measures of a fact table, for the whole table or per dimension value."""
    return df.groupBy(*by).agg(*[expr.alias(name) for name, expr in measures.items()])


def headline_measures(events: DataFrame, incidents: DataFrame, kpi: DataFrame, fleet: DataFrame) -> DataFrame:
    """All measures over the whole star in one row."""
    capacity = fleet.agg(F.count("*") * 8).scalar()
    i = aggregate(incidents, incident_measures()).select(F.struct("*")).scalar()
    k = aggregate(kpi, kpi_measures()).select(F.struct("*")).scalar()
    row = aggregate(events, event_measures()).withColumns({"i": i, "k": k, "fleet_capacity": capacity})
    flat = row.select("total_events", "noise_rate", "distinct_ticks", "i.*", "k.*", "fleet_capacity")
    used = F.try_divide(F.col("gpu_hours"), F.col("fleet_capacity") * F.col("hours"))
    return (
        flat.withColumn("alert_compression", F.try_divide(F.col("total_events"), F.col("total_incidents")))
        .withColumn("gpu_utilization", used)
        .withColumn("headroom", F.lit(1.0) - used)
    )
