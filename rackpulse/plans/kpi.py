"""Queries of the SLA, energy and dashboard KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.functions.columns import one_row
from rackpulse.operators import correlation, energy, sla, summary
from rackpulse.operators.topology import gpus_by
from rackpulse.plans import adapters as A
from rackpulse.plans.correlation import enriched_of, incidents_of
from rackpulse.plans.ctes import DEDUPED, ENRICHED, EVENTS, FLEET, INCIDENTS, TICKETS, UTIL, sql


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def sla_scalars(spark: SparkSession, sf: str) -> DataFrame:
    """Availability, failure and noise rates of the whole fleet over the observed span."""
    events, fleet = A.events(spark, sf), A.fleet(spark, sf)
    incidents = incidents_of(spark, sf)
    critical = F.col("severity_max") == "critical"
    row = events.agg(
        F.count("*").alias("raw"), F.count_if("benign").alias("benign"),
        ((F.max("tick") - F.min("tick") + 1) / 12).alias("hours"),
    ).withColumns(
        {
            "nodes": fleet.agg(F.count("*")).scalar(),
            "i": one_row(
                incidents,
                n=F.count("*"),
                failures=F.count_if(critical),
                down=F.coalesce(F.sum(F.when(critical, F.col("duration_ticks"))), F.lit(0)) / 12,
            ),
        }
    )
    node_hours = F.col("nodes") * F.col("hours")
    return rounded(
        row.select(
            sla.availability(node_hours, F.col("i.down")).alias("availability"),
            sla.mtbf(node_hours, F.col("i.failures")).alias("mtbf_hours"),
            sla.incident_rate(F.col("i.n"), node_hours).alias("incident_rate"),
            sla.alert_compression_ratio(F.col("raw"), F.col("i.n")).alias("compression"),
            sla.noise_rate(F.col("benign"), F.col("raw")).alias("noise_rate"),
        ),
        6, "availability", "mtbf_hours", "incident_rate", "compression", "noise_rate",
    )


def ticket_kpis(spark: SparkSession, sf: str) -> DataFrame:
    kpis = sla.ticket_kpis(A.tickets(spark, sf), "priority")
    return rounded(kpis, 6, "mttr_hours", "mttd_hours", "first_time_resolution")


def incident_ticket_kpis(spark: SparkSession, sf: str) -> DataFrame:
    tickets = correlation.to_tickets(incidents_of(spark, sf), "2024-01-01 00:00:00", within_ticks=3)
    kpis = sla.ticket_kpis(tickets, "priority")
    return rounded(kpis, 6, "mttr_hours", "mttd_hours", "first_time_resolution")


def incident_rate_by_zone(spark: SparkSession, sf: str) -> DataFrame:
    """Raw alerts and critical alerts per 1,000 node-hours of each zone."""
    events = enriched_of(spark, sf)
    hours = A.events(spark, sf).agg((F.max("tick") - F.min("tick") + 1) / 12).scalar()
    per_zone = events.filter("zone_id is not null").groupBy("zone_id").agg(
        F.count("*").alias("alerts"), F.count_if(F.col("severity") == "critical").alias("critical")
    )
    nodes = gpus_by(A.fleet(spark, sf), "zone_id")
    joined = per_zone.join(nodes, "zone_id").withColumn("node_hours", F.col("nodes") * hours)
    return rounded(
        joined.select(
            "zone_id", "alerts", "critical", "nodes", "total_gpus",
            sla.incident_rate(F.col("alerts"), F.col("node_hours")).alias("alert_rate"),
            sla.incident_rate(F.col("critical"), F.col("node_hours")).alias("critical_rate"),
        ),
        6, "alert_rate", "critical_rate",
    )


def power_series(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(energy.power_timeseries(A.utilization(spark, sf)), 6, "fleet_kw", "gpu_hours_in_tick")


def energy_summary(spark: SparkSession, sf: str) -> DataFrame:
    df = energy.energy_summary(A.utilization(spark, sf))
    return rounded(df, 4, *df.columns[:-1]).withColumn("perf_per_watt_tflops", F.round("perf_per_watt_tflops", 8))


def facility_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """PUE and renewable match per tick for a facility drawing 12 % over its IT load, with 500 kWh of renewables."""
    power = energy.power_timeseries(A.utilization(spark, sf))
    return rounded(
        power.select(
            "tick",
            energy.pue(F.col("fleet_kw") * 1.12 + 5, F.col("fleet_kw")).alias("pue"),
            energy.renewable_match(F.lit(10.0), F.col("fleet_kw")).alias("renewable_match"),
        ),
        6, "pue", "renewable_match",
    )


def idle_by_tick(spark: SparkSession, sf: str) -> DataFrame:
    return energy.idle_by_tick(A.utilization(spark, sf))


def idle_waste(spark: SparkSession, sf: str) -> DataFrame:
    """Idle samples, energy and cost per node."""
    util = A.utilization(spark, sf).withColumn("node_id", F.substring_index("gpu_id", "/", 1))
    counts = util.groupBy("node_id").agg(F.count_if(F.col("util") < energy.IDLE_THRESHOLD).alias("idle_samples"))
    kwh = energy.idle_kwh(F.col("idle_samples"))
    return rounded(
        counts.withColumns({"idle_kwh": kwh, "idle_dollars": energy.idle_dollars(kwh)}), 6, "idle_kwh", "idle_dollars"
    )


def node_power(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(energy.node_power(A.utilization(spark, sf)), 5, "watts")


def perf_per_watt(spark: SparkSession, sf: str) -> DataFrame:
    """Efficiency per 28-day block."""
    power = energy.power_timeseries(A.utilization(spark, sf))
    blocks = power.groupBy(F.expr("tick div 336").alias("block")).agg(
        energy.perf_per_watt(F.col("gpu_hours_in_tick"), F.col("fleet_kw")).alias("tflops_per_watt")
    )
    return rounded(blocks, 8, "tflops_per_watt")


def gpu_hours(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(energy.hourly_gpu_hours(A.utilization(spark, sf)), 6, "value")


def util_mean_series(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(energy.mean_utilisation(A.utilization(spark, sf)), 6, "util")


def kind_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return summary.kind_histogram(A.events(spark, sf))


def severity_domain_counts(spark: SparkSession, sf: str) -> DataFrame:
    return summary.severity_domain_counts(A.events(spark, sf), incidents_of(spark, sf))


def activity_bins(spark: SparkSession, sf: str) -> DataFrame:
    return summary.activity_bins(A.events(spark, sf))


def top_incidents(spark: SparkSession, sf: str) -> DataFrame:
    return summary.top_incidents(incidents_of(spark, sf))


def summary_totals(spark: SparkSession, sf: str) -> DataFrame:
    events = A.events(spark, sf)
    deduped = correlation.dedupe(events, A.DEDUPE_WINDOW)
    return summary.dashboard_summary(events, deduped, incidents_of(spark, sf))["totals"]


def fleet_capacity(spark: SparkSession, sf: str) -> DataFrame:
    return gpus_by(A.fleet(spark, sf), "zone_id", "rack_id", "feed_id")


def weekly_kpi_row(spark: SparkSession, sf: str) -> DataFrame:
    row = summary.weekly_kpis(
        A.events(spark, sf), incidents_of(spark, sf), A.fleet(spark, sf), A.utilization(spark, sf), threshold=0.01
    )
    floats = ("compression", "noise_rate", "headroom", "weeks_to_threshold", "avg_kw", "total_kwh", "idle_kwh",
              "idle_dollars")
    return rounded(row, 4, *floats).withColumn("perf_w", F.round("perf_w", 8))


QUERIES = {
    "sla_scalars": sla_scalars,
    "ticket_mttr_by_priority": ticket_kpis,
    "incident_ticket_kpis": incident_ticket_kpis,
    "incident_rate_by_zone": incident_rate_by_zone,
    "power_series": power_series,
    "energy_summary": energy_summary,
    "facility_ratios": facility_ratios,
    "idle_by_tick": idle_by_tick,
    "idle_waste": idle_waste,
    "node_power": node_power,
    "perf_per_watt": perf_per_watt,
    "gpu_hours": gpu_hours,
    "util_mean_series": util_mean_series,
    "kind_histogram": kind_histogram,
    "severity_domain_counts": severity_domain_counts,
    "activity_bins": activity_bins,
    "top_incidents": top_incidents,
    "summary_totals": summary_totals,
    "fleet_capacity": fleet_capacity,
    "weekly_kpi_row": weekly_kpi_row,
}

POWER = f"""{UTIL},
power as (
  select tick, ((avg(util) * 490 + 210) * count(*) + round_even(count(*) / 8, 0) * 600) / 1000 as fleet_kw,
    count(*) filter (util > 0.05) as active_gpu_count, sum(util) as gpu_hours,
    count(*) filter (util < 0.05) as idle_gpu_count
  from util group by tick)"""

_ENERGY = f"""{POWER},
energy as (
  select sum(fleet_kw) as total_kwh, (select count(*) from util where util < 0.05) * 0.21::double as idle_kwh,
    (select sum(util) from util where util >= 0.05) as active_gpu_hours, sum(gpu_hours) as total_gpu_hours,
    avg(fleet_kw) as avg_fleet_kw from power)"""

_TICKET_KPIS = """count(*) as tickets,
  round(coalesce(avg(epoch(resolved_at) - epoch(opened_at)) / 3600, 0), 6) as mttr_hours,
  round(coalesce(avg(epoch(opened_at) - epoch(event_at)) / 3600, 0), 6) as mttd_hours,
  round(case when count(resolved_at) > 0 then (count(resolved_at) - count(*) filter (reopened)) / count(resolved_at)
    else 0 end, 6) as first_time_resolution"""

ORACLES = {
    "sla_scalars": sql(
        INCIDENTS,
        """, base as (
  select (select count(*) from fleet) * (max(tick) - min(tick) + 1) / 12 as nh, count(*) as raw,
    count(*) filter (benign) as benign from ev),
inc as (
  select count(*) as n, count(*) filter (severity_max = 'critical') as fails,
    coalesce(sum(duration_ticks) filter (severity_max = 'critical'), 0) / 12 as down from incidents)
select round(greatest(0, (nh - down) / nh), 6) as availability, round(nh / fails, 6) as mtbf_hours,
  round(1000.0 * n / nh, 6) as incident_rate, round(raw / n, 6) as compression, round(benign / raw, 6) as noise_rate
from base, inc""",
    ),
    "ticket_mttr_by_priority": sql(TICKETS, f"select priority, {_TICKET_KPIS} from tickets group by priority"),
    "incident_ticket_kpis": sql(
        f"""{INCIDENTS},
tickets as (
  select severity_max as priority, to_timestamp(opened_tick * 300) as event_at, to_timestamp(opened_tick * 300) as opened_at,
    to_timestamp(resolved_tick * 300) as resolved_at, exists (
      select 1 from incidents j where j.root_kind = i.root_kind and j.scope = i.scope
        and j.severity_max = i.severity_max and j.incident_id <> i.incident_id
        and j.opened_tick - i.opened_tick between 0 and 3) as reopened
  from incidents i)""",
        f"select priority, {_TICKET_KPIS} from tickets group by priority",
    ),
    "incident_rate_by_zone": sql(
        ENRICHED,
        """, h as (select (max(tick) - min(tick) + 1) / 12 as hours from ev),
z as (select zone_id, count(*) as alerts, count(*) filter (severity = 'critical') as critical from enriched
  where zone_id is not null group by zone_id),
n as (select zone_id, count(*) as nodes from fleet group by zone_id)
select zone_id, alerts, critical, nodes, nodes * 8 as total_gpus, round(1000.0 * alerts / (nodes * hours), 6) as alert_rate,
  round(1000.0 * critical / (nodes * hours), 6) as critical_rate from z join n using (zone_id), h""",
    ),
    "power_series": sql(
        POWER,
        "select tick, round(fleet_kw, 6) as fleet_kw, active_gpu_count, round(gpu_hours, 6) as gpu_hours_in_tick from power",
    ),
    "energy_summary": sql(
        _ENERGY,
        """select round(total_kwh, 4) as total_kwh, round(idle_kwh, 4) as idle_kwh,
  round(idle_kwh * 0.06::double, 4) as idle_waste_dollars, round(active_gpu_hours, 4) as active_gpu_hours,
  round(total_gpu_hours, 4) as total_gpu_hours, round(avg_fleet_kw, 4) as avg_fleet_kw,
  round(total_gpu_hours * 1000 / (total_kwh * 1000), 8) as perf_per_watt_tflops from energy""",
    ),
    "facility_ratios": sql(
        POWER,
        "select tick, round((fleet_kw * 1.12::double + 5) / fleet_kw, 6) as pue,"
        " round(least(1.0, 10 / fleet_kw), 6) as renewable_match from power",
    ),
    "idle_by_tick": sql(POWER, "select tick, idle_gpu_count from power"),
    "idle_waste": sql(
        UTIL,
        """select split_part(gpu_id, '/', 1) as node_id, count(*) filter (util < 0.05) as idle_samples,
  round(count(*) filter (util < 0.05) * 0.21::double, 6) as idle_kwh,
  round(count(*) filter (util < 0.05) * 0.21::double * 0.06::double, 6) as idle_dollars from util group by 1""",
    ),
    "node_power": sql(
        UTIL,
        "select split_part(gpu_id, '/', 1) as node_id, tick, round(600 + sum(700 * (0.3::double + 0.7::double * util)), 5)"
        " as watts from util group by 1, 2",
    ),
    "perf_per_watt": sql(
        POWER,
        "select tick // 336 as block, round(sum(gpu_hours * 1000) / (sum(fleet_kw) * 1000), 8) as tflops_per_watt"
        " from power group by 1",
    ),
    "gpu_hours": sql(UTIL, "select tick, round(sum(util), 6) as value from util group by tick"),
    "util_mean_series": sql(UTIL, "select tick, round(avg(util), 6) as util from util group by tick"),
    "kind_histogram": sql(EVENTS, "select kind, count(*) as count from ev group by kind order by 2 desc, 1"),
    "severity_domain_counts": sql(
        INCIDENTS,
        """select s.severity, (select count(*) from ev e where e.severity = s.severity) as raw,
  (select count(*) from incidents i where i.severity_max = s.severity) as incidents
from (values ('info'), ('warn'), ('critical')) s(severity)""",
    ),
    "activity_bins": sql(
        EVENTS,
        """, span as (select min(tick) as lo, max(tick) as hi, greatest(1, (max(tick) - min(tick)) // 48) as w from ev),
edges as (select unnest(generate_series(lo, hi, w)) as left_edge, w, hi from span)
select cast(trunc(left_edge + w / 2) as bigint) as tick,
  cast(sum(case severity when 'critical' then 3 when 'warn' then 2 else 1 end) as bigint) as activity
from edges join ev on ev.tick > left_edge and ev.tick <= left_edge + w where left_edge + w <= hi group by 1""",
    ),
    "top_incidents": sql(
        INCIDENTS,
        """select left(incident_id, 80) as incident_id, root_kind, scope, member_count, severity_max, any_benign,
  opened_tick, duration_ticks from incidents order by member_count desc, opened_tick, incidents.incident_id limit 10""",
    ),
    "summary_totals": sql(
        INCIDENTS,
        "select (select count(*) from ev) as raw_events, (select count(*) from deduped) as deduped,"
        " (select count(*) from incidents) as incidents",
    ),
    "fleet_capacity": sql(
        FLEET,
        "select zone_id, rack_id, feed_id, count(*) as nodes, count(*) * 8 as total_gpus from fleet group by all",
    ),
}
