"""Sliding look-back / look-ahead windows as arithmetic on the tick, so containment needs no range join.

Window ``k`` ends at ``lookback + k * step``. A row is copied to each window that contains it, which turns
"rows in window" into an ordinary equi-group on ``window_end_tick``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackpulse.functions.columns import floor_div
from rackpulse.schemas import TICKS_PER_HOUR


@dataclass(frozen=True)
class Hops:
    """Window geometry in ticks."""

    lookback: int
    horizon: int
    step: int

    @classmethod
    def hours(cls, lookback: int = 48, horizon: int = 24, step: int = 6, ticks_per_hour: int = TICKS_PER_HOUR) -> Hops:
        return cls(lookback * ticks_per_hour, horizon * ticks_per_hour, step * ticks_per_hour)

    def last(self, max_tick: Column) -> Column:
        """Index of the last window with a complete look-ahead; negative when there is none."""
        return floor_div(max_tick - self.horizon - self.lookback, self.step)

    def end(self, k: Column) -> Column:
        return k * self.step + self.lookback

    def lookback_span(self, tick: Column, last: Column) -> tuple[Column, Column]:
        """First and last window whose [end - lookback, end) holds ``tick``."""
        first = floor_div(tick - self.lookback, self.step) + 1
        return F.greatest(first, F.lit(0)), F.least(floor_div(tick, self.step), last)

    def horizon_span(self, tick: Column, last: Column) -> tuple[Column, Column]:
        """First and last window whose [end, end + horizon) holds ``tick``."""
        first = floor_div(tick - self.horizon - self.lookback, self.step) + 1
        return F.greatest(first, F.lit(0)), F.least(floor_div(tick - self.lookback, self.step), last)


def last_tick(*tables: DataFrame) -> Column:
    """Largest tick over all tables, as a scalar subquery; null when one of them is empty."""
    tops = [t.agg(F.max("tick").alias("tick")) for t in tables]
    merged = tops[0]
    for top in tops[1:]:
        merged = merged.unionByName(top)
    return merged.agg(F.when(F.count("tick") == len(tables), F.max("tick")).alias("tick")).scalar()


def to_windows(df: DataFrame, hops: Hops, max_tick: Column, ahead: bool = False) -> DataFrame:
    """Copy each row to the windows containing its tick, as column ``window_end_tick``."""
    span = hops.horizon_span if ahead else hops.lookback_span
    lo, hi = span(F.col("tick"), hops.last(max_tick))
    return (
        df.withColumns({"_lo": lo, "_hi": hi})
        .filter("_lo <= _hi")
        .withColumn("window_end_tick", F.explode(F.sequence("_lo", "_hi")))
        .withColumn("window_end_tick", hops.end(F.col("window_end_tick")))
        .drop("_lo", "_hi")
    )


def all_windows(df: DataFrame, hops: Hops, max_tick: Column) -> DataFrame:
    """Every row once per window of the run (skeleton of a per-window table)."""
    return (
        df.withColumn("_last", hops.last(max_tick))
        .filter("_last >= 0")
        .withColumn("window_end_tick", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))))
        .withColumn("window_end_tick", hops.end(F.col("window_end_tick")))
        .drop("_last")
    )


def to_chunks(
    df: DataFrame, hops: Hops, max_tick: Column, key: str, windows_per_chunk: int | None = None
) -> DataFrame:
    """Rows hash-partitioned by ``key`` and a run of consecutive windows (``_chunk``), ready for :func:`open_chunks`.

    Copying a row to every window before the shuffle would multiply the shuffled data by lookback / step. Here a row
    moves once per chunk it overlaps (1.25 times on average with the default length) and is copied to its windows on
    the receiving side. The chunk also splits the history of a busy key over many tasks. Grouping or windowing by
    (``key``, ``_chunk``, ...) afterwards needs no further exchange.
    """
    size = windows_per_chunk or 4 * max(1, -(-hops.lookback // hops.step))
    lo, hi = hops.lookback_span(F.col("tick"), hops.last(max_tick))
    chunks = F.sequence(floor_div(F.col("_lo"), size), floor_div(F.col("_hi"), size))
    return (
        df.withColumns({"_lo": lo, "_hi": hi})
        .filter("_lo <= _hi")
        .withColumn("_chunk", F.explode(chunks))
        .withColumn("_lo", F.greatest("_lo", F.col("_chunk") * size))
        .withColumn("_hi", F.least("_hi", F.col("_chunk") * size + size - 1))
        .repartition(key, "_chunk")
    )


def open_chunks(chunked: DataFrame, hops: Hops) -> DataFrame:
    """Copy each row to the windows of its chunk that contain it."""
    return (
        chunked.withColumn("window_end_tick", F.explode(F.sequence("_lo", "_hi")))
        .withColumn("window_end_tick", hops.end(F.col("window_end_tick")))
        .drop("_lo", "_hi")
    )
