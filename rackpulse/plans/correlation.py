"""Queries of the event correlation chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.operators import correlation as C
from rackpulse.operators.topology import enrich_with_topology
from rackpulse.plans import adapters as A
from rackpulse.plans.ctes import DEDUPED, ENRICHED, INCIDENTS, sql


def incidents_of(spark: SparkSession, sf: str) -> DataFrame:
    return C.build_incidents(A.events(spark, sf), A.fleet(spark, sf), A.DEDUPE_WINDOW, A.BURST_WINDOW)


def enriched_of(spark: SparkSession, sf: str) -> DataFrame:
    return enrich_with_topology(A.events(spark, sf), A.fleet(spark, sf))


def deduped_of(spark: SparkSession, sf: str) -> DataFrame:
    """Deduped, then placed: the keep rule ignores topology."""
    return enrich_with_topology(C.dedupe(A.events(spark, sf), A.DEDUPE_WINDOW), A.fleet(spark, sf))


def cascade_members(spark: SparkSession, sf: str) -> DataFrame:
    return (
        deduped_of(spark, sf)
        .filter(F.col("parent_event_id").isNotNull())
        .select(C.incident_key(A.BURST_WINDOW).alias("incident_id"), "event_id", "tick", "kind", "severity")
    )


def burst_keys(spark: SparkSession, sf: str) -> DataFrame:
    return (
        deduped_of(spark, sf)
        .filter(F.col("parent_event_id").isNull())
        .groupBy(C.incident_key(A.BURST_WINDOW).alias("incident_id"))
        .agg(F.count("*").alias("members"))
    )


def incident_severity_mix(spark: SparkSession, sf: str) -> DataFrame:
    return (
        incidents_of(spark, sf)
        .groupBy("root_kind", "severity_max")
        .agg(
            F.count("*").alias("incidents"),
            F.sum("member_count").alias("members"),
            F.count_if("all_benign").alias("benign_incidents"),
        )
    )


def repeat_openings(spark: SparkSession, sf: str) -> DataFrame:
    flagged = C.repeat_openings(incidents_of(spark, sf), within_ticks=3)
    return flagged.select("incident_id", "opened_tick", "reopened")


def incident_tickets(spark: SparkSession, sf: str) -> DataFrame:
    tickets = C.to_tickets(incidents_of(spark, sf), "2024-01-01 00:00:00", within_ticks=3)
    return tickets.withColumns(
        {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("event_at", "opened_at", "resolved_at")}
    )


QUERIES = {
    "enrich_topology": enriched_of,
    "flap_dedupe": deduped_of,
    "cascade_members": cascade_members,
    "burst_keys": burst_keys,
    "incidents": incidents_of,
    "incident_severity_mix": incident_severity_mix,
    "repeat_openings": repeat_openings,
    "incident_tickets": incident_tickets,
}

_REPEATS = f"""{INCIDENTS},
flagged as (
  select i.*, exists (
    select 1 from incidents j where j.root_kind = i.root_kind and j.scope = i.scope
      and j.severity_max = i.severity_max and j.incident_id <> i.incident_id
      and j.opened_tick - i.opened_tick between 0 and 3) as reopened
  from incidents i)"""

ORACLES = {
    "enrich_topology": sql(ENRICHED, "select * from enriched"),
    "flap_dedupe": sql(DEDUPED, "select * from deduped"),
    "cascade_members": sql(
        DEDUPED,
        "select 'cascade:' || parent_event_id as incident_id, event_id, tick, kind, severity from deduped"
        " where parent_event_id is not null",
    ),
    "burst_keys": sql(
        INCIDENTS,
        "select incident_id, count(*) as members from keyed where parent_event_id is null group by incident_id",
    ),
    "incidents": sql(INCIDENTS, "select * from incidents"),
    "incident_severity_mix": sql(
        INCIDENTS,
        "select root_kind, severity_max, count(*) as incidents, cast(sum(member_count) as bigint) as members,"
        " count(*) filter (all_benign) as benign_incidents from incidents group by all",
    ),
    "repeat_openings": sql(_REPEATS, "select incident_id, opened_tick, reopened from flagged"),
    "incident_tickets": sql(
        _REPEATS,
        """select incident_id, severity_max as priority,
  strftime(timestamp '2024-01-01' + to_seconds(opened_tick * 300), '%Y-%m-%d %H:%M:%S') as event_at,
  strftime(timestamp '2024-01-01' + to_seconds(opened_tick * 300), '%Y-%m-%d %H:%M:%S') as opened_at,
  strftime(timestamp '2024-01-01' + to_seconds(resolved_tick * 300), '%Y-%m-%d %H:%M:%S') as resolved_at,
  reopened
from flagged""",
    ),
}
