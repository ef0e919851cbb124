"""Queries of the star schema and its measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.operators import star as S
from rackpulse.operators.energy import hourly_kpi
from rackpulse.plans import adapters as A
from rackpulse.plans.correlation import enriched_of, incidents_of
from rackpulse.plans.ctes import ENRICHED, EVENTS, FLEET, INCIDENTS, UTIL, sql
from rackpulse.plans.kpi import POWER, rounded
from rackpulse.plans.rootcause import FAMILIES, clustered_of
from rackpulse.schemas import STAR
from rackpulse.session import materialise
from rackpulse.sources import star_files


def star_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return S.star_schema(
        enriched_of(spark, sf), materialise(clustered_of(spark, sf), "clustered"), A.utilization(spark, sf), A.fleet(spark, sf)
    )


def dim_time(spark: SparkSession, sf: str) -> DataFrame:
    calendar = S.dim_time(A.events(spark, sf), A.utilization(spark, sf))
    return calendar.withColumns(
        {"datetime": F.date_format("datetime", "yyyy-MM-dd HH:mm:ss"), "date": F.col("date").cast("string")}
    )


def fact_events(spark: SparkSession, sf: str) -> DataFrame:
    return enriched_of(spark, sf).select(*STAR["fact_events"].names)


def fact_hourly_kpi(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(hourly_kpi(A.utilization(spark, sf)), 6, "fleet_kw", "gpu_hours")


def fact_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(star_tables(spark, sf)["fact_clusters"], 6, "all_benign_ratio", "mean_members")


def star_orphans(spark: SparkSession, sf: str) -> DataFrame:
    return S.orphans(star_tables(spark, sf))


def star_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Row counts of the star after being written as CSV and read back with its declared types."""
    tables = star_tables(spark, sf)
    root = star_files.export_to_work_dir(spark, tables)
    back = star_files.read_csv_star(spark, root)
    counts = [df.agg(F.lit(name).alias("table"), F.count("*").alias("rows")) for name, df in back.items()]
    merged = counts[0]
    for count in counts[1:]:
        merged = merged.unionByName(count)
    return merged


def headline_measures(spark: SparkSession, sf: str) -> DataFrame:
    df = S.headline_measures(
        enriched_of(spark, sf), incidents_of(spark, sf), hourly_kpi(A.utilization(spark, sf)), A.fleet(spark, sf)
    )
    return rounded(df, 4, *[f.name for f in df.schema.fields if f.dataType.typeName() == "double"])


def event_measures_by_zone_hour(spark: SparkSession, sf: str) -> DataFrame:
    events = enriched_of(spark, sf).withColumn("hour", F.expr("cast(pmod(tick div 12, 24) as int)"))
    return rounded(S.aggregate(events, S.event_measures(), "zone_id", "hour"), 6, "noise_rate")


def incident_measures_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.aggregate(incidents_of(spark, sf), S.incident_measures(), "root_kind", "scope"), 6, "mttr_hours")


def energy_measures_by_weekday(spark: SparkSession, sf: str) -> DataFrame:
    util = A.utilization(spark, sf)
    kpi = hourly_kpi(util).join(S.dim_time(util).select("tick", "day_of_week", "is_weekend"), "tick")
    df = S.aggregate(kpi, S.kpi_measures(), "day_of_week", "is_weekend")
    return rounded(
        df, 4, "total_energy_kwh", "aggregate_tflops", "perf_per_watt", "avg_fleet_kw", "idle_energy_kwh", "idle_cost",
        "gpu_hours",
    )


QUERIES = {
    "dim_time": dim_time,
    "dim_fleet": A.fleet,
    "fact_events": fact_events,
    "fact_incidents": clustered_of,
    "fact_hourly_kpi": fact_hourly_kpi,
    "fact_clusters": fact_clusters,
    "star_orphans": star_orphans,
    "star_round_trip": star_round_trip,
    "headline_measures": headline_measures,
    "event_measures_by_zone_hour": event_measures_by_zone_hour,
    "incident_measures_by_kind": incident_measures_by_kind,
    "energy_measures_by_weekday": energy_measures_by_weekday,
}

_TIME = f"""{EVENTS},{UTIL},
dim_time as (
  select t as tick, timestamp '2026-05-01' + to_seconds(t * 300) as dt
  from (select unnest(generate_series(0, greatest((select max(tick) from ev), (select max(tick) from util)))) as t))"""

_KPI_SUMS = """sum(fleet_kw) as energy, sum(gpu_hours * 1000) as tflops, avg(fleet_kw) as draw, sum(idle_gpu_count) as idle,
    sum(gpu_hours) as gpu_hours, count(*) as hours"""
_KPI_OUT = """round(energy, 4) as total_energy_kwh, round(tflops, 4) as aggregate_tflops,
  round(tflops / (energy * 1000), 4) as perf_per_watt, round(draw, 4) as avg_fleet_kw, cast(idle as bigint) as idle_gpu_hours,
  round(idle * 0.21::double, 4) as idle_energy_kwh, round(idle * 0.21::double * 0.06::double, 4) as idle_cost,
  round(gpu_hours, 4) as gpu_hours, hours"""

_CLUSTER_ROWS = """select cluster_id, cluster_label, count(*) as count, count(*) filter (severity_max = 'critical') as critical_count,
  round(avg(all_benign::int), 6) as all_benign_ratio, round(avg(member_count), 6) as mean_members
from clustered join names using (cluster_id) where cluster_id <> -1
group by all order by count desc, cluster_id limit 50"""

ORACLES = {
    "dim_time": sql(
        _TIME,
        """select tick, strftime(dt, '%Y-%m-%d %H:%M:%S') as datetime, strftime(dt, '%Y-%m-%d') as date,
  hour(dt) as hour, dayname(dt) as day_of_week, isodow(dt) >= 6 as is_weekend from dim_time""",
    ),
    "dim_fleet": sql(FLEET, "select * from fleet"),
    "fact_events": sql(ENRICHED, "select * exclude (event_id) from enriched"),
    "fact_incidents": sql(
        FAMILIES,
        """select incident_id, opened_tick, resolved_tick, member_count, root_kind, scope, severity_max, all_benign, any_benign,
  duration_ticks, cluster_id, cluster_label from clustered join names using (cluster_id)""",
    ),
    "fact_hourly_kpi": sql(
        POWER,
        "select tick, round(fleet_kw, 6) as fleet_kw, active_gpu_count, round(gpu_hours, 6) as gpu_hours, idle_gpu_count"
        " from power",
    ),
    "fact_clusters": sql(FAMILIES, _CLUSTER_ROWS),
    "star_orphans": sql(
        f"{FAMILIES},{POWER},\nfc as ({_CLUSTER_ROWS}),\n"
        "tops as (select greatest((select max(tick) from ev), (select max(tick) from util)) as top)",
        """select 'fact_events.node_id' as left, 'dim_fleet.node_id' as right, count(distinct node_id) as orphan_keys,
  count(*) as orphan_rows from enriched where node_id is not null and node_id not in (select node_id from fleet)
union all select 'fact_events.tick', 'dim_time.tick', count(distinct tick), count(*) from enriched, tops where tick > top or tick < 0
union all select 'fact_hourly_kpi.tick', 'dim_time.tick', count(distinct tick), count(*) from power, tops where tick > top or tick < 0
union all select 'fact_incidents.cluster_id', 'fact_clusters.cluster_id', count(distinct cluster_id), count(*) from clustered
  where cluster_id not in (select cluster_id from fc)""",
    ),
    "star_round_trip": sql(
        f"{FAMILIES},{POWER},\nfc as ({_CLUSTER_ROWS})",
        """select 'fact_events' as table, count(*) as rows from enriched
union all select 'fact_incidents', count(*) from clustered union all select 'fact_hourly_kpi', count(*) from power
union all select 'fact_clusters', count(*) from fc union all select 'dim_fleet', count(*) from fleet
union all select 'dim_time', 1 + greatest((select max(tick) from ev), (select max(tick) from util))""",
    ),
    "headline_measures": sql(
        f"{INCIDENTS},{POWER}",
        f""", e as (select count(*) as total_events, count(*) filter (benign) / count(*) as noise, count(distinct tick) as ticks from ev),
i as (select count(*) as total_incidents, count(*) filter (severity_max = 'critical') as critical,
  avg(duration_ticks / 12) as mttr from incidents),
k as (select {_KPI_SUMS} from power),
f as (select count(*) * 8 as capacity from fleet)
select total_events, round(noise, 4) as noise_rate, ticks as distinct_ticks, total_incidents, critical as critical_incidents,
  round(mttr, 4) as mttr_hours, {_KPI_OUT}, capacity as fleet_capacity, round(total_events / total_incidents, 4) as alert_compression,
  round(gpu_hours / (capacity * hours), 4) as gpu_utilization, round(1 - gpu_hours / (capacity * hours), 4) as headroom
from e, i, k, f""",
    ),
    "event_measures_by_zone_hour": sql(
        ENRICHED,
        """select zone_id, cast((tick // 12) % 24 as int) as hour, count(*) as total_events,
  round(count(*) filter (benign) / count(*), 6) as noise_rate, count(distinct tick) as distinct_ticks
from enriched group by 1, 2""",
    ),
    "incident_measures_by_kind": sql(
        INCIDENTS,
        """select root_kind, scope, count(*) as total_incidents, count(*) filter (severity_max = 'critical') as critical_incidents,
  round(avg(duration_ticks / 12), 6) as mttr_hours from incidents group by 1, 2""",
    ),
    "energy_measures_by_weekday": sql(
        f"{POWER},\nk as (select dayname(timestamp '2026-05-01' + to_seconds(tick * 300)) as day_of_week,"
        " isodow(timestamp '2026-05-01' + to_seconds(tick * 300)) >= 6 as is_weekend, * from power),"
        f"\ns as (select day_of_week, is_weekend, {_KPI_SUMS} from k group by 1, 2)",
        f"select day_of_week, is_weekend, {_KPI_OUT} from s",
    ),
}
