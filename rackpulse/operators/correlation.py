"""Flap dedupe and incident correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rackpulse.functions.columns import floor_div, severity_name, severity_rank
from rackpulse.operators.topology import enrich_with_topology
from rackpulse.schemas import TOPOLOGY


def _tie_break(events: DataFrame, order_by: Sequence[str] | None) -> list[str]:
    if order_by is not None:
        return list(order_by)
    return ["event_id"] if "event_id" in events.columns else [c for c in events.columns if c != "tick"]


def dedupe(events: DataFrame, window_ticks: int = 5, order_by: Sequence[str] | None = None) -> DataFrame:
    """Per (kind, target), keep an event when it is the first, critical, or more than the window after the last kept one.

    Critical events pass straight through. The others are first reduced, map side, to the earliest row of each
    (kind, target, tick): at one tick no later non-critical row can survive. That leaves at most one cell per tick and
    key, so a key that holds a third of all rows costs a task no more than the number of ticks in the data. Cells are
    then cut into runs that do not influence one another, and the keep rule is folded inside each run.
    """
    ties = _tie_break(events, order_by)
    columns = events.columns
    row = F.struct(*columns)
    order = F.struct("tick", *ties)
    cells = events.groupBy("kind", "target", "tick").agg(
        F.min_by(row, order).alias("first"),
        F.bool_or(F.coalesce(F.col("severity") == "critical", F.lit(False))).alias("critical"),
    )
    by_key = W.partitionBy("kind", "target").orderBy("tick")
    previous, after_critical = F.lag("tick").over(by_key), F.lag("critical").over(by_key)
    starts = previous.isNull() | (F.col("tick") - previous > window_ticks) | after_critical
    runs = (
        cells.withColumns({"_start": starts, "_seed": F.when(after_critical, previous)})
        .withColumn("_run", F.sum(F.col("_start").cast("long")).over(by_key))
        .groupBy("kind", "target", "_run")
        .agg(
            F.min(F.when(F.col("_start"), F.col("_seed"))).alias("seed"),
            F.array_sort(F.collect_list(F.struct("tick", "critical", "first"))).alias("cells"),
        )
    )
    kept = runs.select(F.explode(_fold(window_ticks)).alias("first")).select("first.*")
    return kept.unionByName(events.filter(F.col("severity") == "critical")).select(*columns)


def _fold(window_ticks: int) -> Column:
    """Surviving non-critical rows of one run, given the last kept tick before it."""

    def step(state: Column, cell: Column) -> Column:
        open_again = state["last"].isNull() | (cell["tick"] - state["last"] > window_ticks)
        survives = open_again & (F.coalesce(cell["first"]["severity"], F.lit("")) != "critical")
        return F.struct(
            F.when(survives | cell["critical"], cell["tick"]).otherwise(state["last"]).alias("last"),
            F.when(survives, F.concat(state["rows"], F.array(cell["first"]))).otherwise(state["rows"]).alias("rows"),
        )

    nothing = F.filter(F.transform("cells", lambda c: c["first"]), lambda _: F.lit(False))
    start = F.struct(F.col("seed").alias("last"), nothing.alias("rows"))
    return F.aggregate("cells", start, step, lambda s: s["rows"])


def incident_key(time_window_ticks: int, topology: Sequence[str] = TOPOLOGY) -> Column:
    """Incident of an enriched event: its cascade, else its co-located burst, else its own target."""
    place = F.coalesce(
        *[F.concat(F.lit(f"{c}="), F.col(c)) for c in topology], F.concat(F.lit("solo="), F.col("target"))
    )
    bucket = floor_div(F.col("tick"), time_window_ticks).cast("string")
    burst = F.concat(F.lit("burst:"), F.col("kind"), F.lit("|"), place, F.lit("|t"), bucket)
    return F.when(
        F.col("parent_event_id").isNotNull(), F.concat(F.lit("cascade:"), F.col("parent_event_id"))
    ).otherwise(burst)


def max_severity(severity: Column) -> Column:
    """Highest severity of a group, ignoring nulls; info for a group without any."""
    return severity_name(F.coalesce(F.max(F.when(severity.isNotNull(), severity_rank(severity))), F.lit(0)))


def correlate(
    enriched: DataFrame, time_window_ticks: int = 10, order_by: Sequence[str] | None = None
) -> DataFrame:
    """One row per incident: a single hash-partitioned aggregate with map-side partials."""
    ties = _tie_break(enriched, order_by)
    topology = [c for c in TOPOLOGY if c in enriched.columns]
    benign = F.col("benign")
    grouped = (
        enriched.withColumn("incident_id", incident_key(time_window_ticks, topology))
        .groupBy("incident_id")
        .agg(
            F.min("tick").alias("opened_tick"),
            F.max("tick").alias("resolved_tick"),
            F.count("tick").alias("member_count"),
            F.min(F.struct("tick", *ties, F.col("kind").alias("_kind"), F.col("scope").alias("_scope"))).alias("_root"),
            max_severity(F.col("severity")).alias("severity_max"),
            F.bool_and(benign).alias("all_benign"),
            F.bool_or(benign).alias("any_benign"),
        )
    )
    return grouped.select(
        "incident_id",
        "opened_tick",
        "resolved_tick",
        "member_count",
        F.col("_root._kind").alias("root_kind"),
        F.col("_root._scope").alias("scope"),
        "severity_max",
        "all_benign",
        "any_benign",
        (F.col("resolved_tick") - F.col("opened_tick")).alias("duration_ticks"),
    )


def build_incidents(
    events: DataFrame, fleet: DataFrame, dedupe_window: int = 5, burst_window: int = 15
) -> DataFrame:
    """Dedupe, place and correlate.

    The dedupe rule does not look at topology, so it runs first and the join sees only the surviving events.
    """
    return correlate(enrich_with_topology(dedupe(events, dedupe_window), fleet), burst_window)


def repeat_openings(incidents: DataFrame, within_ticks: int) -> DataFrame:
    """Incidents with a flag for those whose (kind, scope, severity) opened again within the given time.

    The next opening of a signature is looked up over its distinct opening ticks, which time bounds, not over its
    incidents: two incidents on the same tick count as a repeat of each other.
    """
    signature = ["root_kind", "scope", "severity_max"]
    openings = incidents.groupBy(*signature, "opened_tick").agg(F.count("*").alias("_same"))
    following = F.lead("opened_tick").over(W.partitionBy(*signature).orderBy("opened_tick"))
    reopened = (F.col("_same") > 1) | F.coalesce(following - F.col("opened_tick") <= within_ticks, F.lit(False))
    keys = [*signature, "opened_tick"]
    gaps = openings.select(*[F.col(c).alias(f"_{c}") for c in keys], reopened.alias("reopened"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    return incidents.join(gaps, same).drop(*[f"_{c}" for c in keys])


def to_tickets(incidents: DataFrame, epoch: str, within_ticks: int = 288, seconds_per_tick: int = 300) -> DataFrame:
    """Service tickets of incidents: opened at the first event, resolved at the last, with the repeat flag.

    An incident carries no separate detection time, so the event and the opening coincide.
    """

    def at(tick: str) -> Column:
        return F.timestamp_seconds(
            F.unix_timestamp(F.lit(epoch).cast("timestamp")) + F.col(tick) * seconds_per_tick
        )

    return repeat_openings(incidents, within_ticks).select(
        "incident_id",
        F.col("severity_max").alias("priority"),
        at("opened_tick").alias("event_at"),
        at("opened_tick").alias("opened_at"),
        at("resolved_tick").alias("resolved_at"),
        "reopened",
    )
