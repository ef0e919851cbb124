"""Dedupe, burst correlation and hopping-window statistics on event streams with a ``ts`` timestamp."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rackpulse.functions.columns import floor_div
from rackpulse.operators.topology import enrich_with_topology
from rackpulse.schemas import SECONDS_PER_TICK, TOPOLOGY

#: Groups of (kind, target) keys. A group is one state row and one call, so many keys cost few calls.
SHARDS = 4096

ROW = ("event_id", "tick", "kind", "scope", "target", "severity", "benign", "parent_event_id")


def aligned(origin_seconds: int, every_seconds: int) -> str:
    """Start offset that makes Spark's 1970-based windows begin at the tick epoch."""
    return f"{origin_seconds % every_seconds} seconds"


class KeepRule(StatefulProcessor):
    """Per shard of (kind, target) keys: their last kept ticks. Cells arrive after the watermark, so a later batch only holds later
    ticks, and a key that fell behind by more than the window needs no state."""

    def __init__(self, window_ticks: int):
        self.window_ticks = window_ticks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "kinds array<string>, targets array<string>, ticks array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        cells = pd.concat(rows)
        kinds, targets, ticks = self.last.get() or ([], [], [])
        last = dict(zip(zip(kinds, targets, strict=True), ticks, strict=True))
        cells = cells.iloc[np.argsort(cells["tick"].to_numpy(), kind="stable")]
        kept = []
        for position, (kind, target, tick, critical, severity) in enumerate(
            zip(*[cells[c].tolist() for c in ("kind", "target", "tick", "critical", "severity")], strict=True)
        ):
            before = last.get((kind, target))
            survives = severity != "critical" and (before is None or tick - before > self.window_ticks)
            if survives:
                kept.append(position)
            if survives or critical:
                last[kind, target] = tick
        open_until = tick - self.window_ticks
        held = [(*name, int(at)) for name, at in last.items() if at >= open_until]
        self.last.update(tuple([row[i] for row in held] for i in range(3)))
        yield cells.iloc[kept].drop(columns=["critical", "shard"])

    def close(self) -> None:
        pass


def dedupe_stream(events: DataFrame, window_ticks: int = 5, delay: str = "10 minutes") -> DataFrame:
    """Streaming form of the flap dedupe, emitted in watermark order.

    As in the batch form critical events pass through, and the others are reduced to the first row of each
    (kind, target, tick) by a watermarked aggregate before the keyed state sees them. A busy key therefore costs its
    state operator one row per tick. Keys are dealt to shards by hash: Python is called once per shard and batch, not
    once per key.
    """
    columns = [c for c in ROW if c in events.columns]
    timed = events.withWatermark("ts", delay)
    cells = (
        timed.groupBy(F.window("ts", f"{SECONDS_PER_TICK} seconds"), "kind", "target")
        .agg(
            F.min_by(F.struct(*columns), F.struct("tick", "event_id")).alias("first"),
            F.bool_or(F.col("severity") == "critical").alias("critical"),
        )
        .select("first.*", "critical")
        .withColumn("shard", F.pmod(F.xxhash64("kind", "target"), F.lit(SHARDS)))
    )
    schema = cells.drop("critical", "shard").schema
    kept = cells.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=KeepRule(window_ticks), outputStructType=schema, outputMode="append", timeMode="none"
    )
    return kept.select(*columns).unionByName(events.filter(F.col("severity") == "critical").select(*columns))


def burst_stream(
    events: DataFrame, fleet: DataFrame, window_ticks: int = 15, origin_seconds: int = 0, delay: str = "10 minutes"
) -> DataFrame:
    """Co-located bursts per tumbling window, final once the watermark has passed the window.

    Count, first and last tick combine before the shuffle, and state holds one row per open burst.
    """
    span = window_ticks * SECONDS_PER_TICK
    place = F.coalesce(
        *[F.concat(F.lit(f"{c}="), F.col(c)) for c in TOPOLOGY], F.concat(F.lit("solo="), F.col("target"))
    )
    placed = enrich_with_topology(events.filter("parent_event_id is null"), fleet).withColumn("place", place)
    bursts = (
        placed.withWatermark("ts", delay)
        .groupBy(F.window("ts", f"{span} seconds", startTime=aligned(origin_seconds, span)), "kind", "place")
        .agg(
            F.count("*").alias("member_count"),
            F.min("tick").alias("opened_tick"),
            F.max("tick").alias("resolved_tick"),
            F.bool_and("benign").alias("all_benign"),
        )
    )
    bucket = floor_div(F.unix_seconds("window.start") - origin_seconds, span)
    return bursts.select(
        F.concat(F.lit("burst:"), "kind", F.lit("|"), "place", F.lit("|t"), bucket.cast("string")).alias("incident_id"),
        "member_count", "opened_tick", "resolved_tick", "all_benign",
    )


def window_stats_stream(
    samples: DataFrame,
    key: str,
    value: str,
    lookback_hours: int = 48,
    step_hours: int = 6,
    origin_seconds: int = 0,
    delay: str = "10 minutes",
) -> DataFrame:
    """Hopping-window statistics of a value per key; rows later than the watermark are dropped."""
    start = aligned(origin_seconds, step_hours * 3600)
    hops = F.window("ts", f"{lookback_hours} hours", f"{step_hours} hours", start)
    stats = (
        samples.withWatermark("ts", delay)
        .groupBy(hops, key)
        .agg(
            F.count(value).alias("n"),
            F.avg(value).alias("mean"),
            F.stddev_pop(value).alias("std"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
        )
    )
    end = floor_div(F.unix_seconds("window.end") - origin_seconds, SECONDS_PER_TICK)
    return stats.select(key, end.alias("window_end_tick"), "n", "mean", "std", "min", "max")
