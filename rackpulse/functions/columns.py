"""Scalar column expressions of the data model."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackpulse.schemas import SEVERITIES, TICKS_PER_HOUR


def node_of_target(target: Column) -> Column:
    """Node named by an event target, null when the target is not a node or a GPU of one."""
    return F.when(target.startswith("node-"), F.substring_index(target, "/", 1))


def node_of_gpu(gpu_id: Column) -> Column:
    return F.substring_index(gpu_id, "/", 1)


def compose_gpu_id(node_id: Column, index: Column) -> Column:
    return F.concat(F.coalesce(node_id, F.lit("node-unknown")), F.lit("/gpu"), index.cast("string"))


def severity_rank(severity: Column) -> Column:
    """info 0, warn 1, critical 2; anything else counts as info."""
    rank = F.lit(0)
    for value, name in enumerate(SEVERITIES):
        if value:
            rank = F.when(severity == name, value).otherwise(rank)
    return rank


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), rank.cast("int") + 1)


def hour_of_day(tick: Column, ticks_per_hour: int = TICKS_PER_HOUR) -> Column:
    return F.pmod(floor_div(tick, ticks_per_hour), F.lit(24))


def day_bucket(tick: Column, ticks_per_hour: int = TICKS_PER_HOUR) -> Column:
    return floor_div(tick, 24 * ticks_per_hour)


def floor_div(value: Column, divisor: int) -> Column:
    """Integer floor division, also right for negative values; exact below 2**52."""
    return F.floor(value / F.lit(divisor))


def cyclical(hour: Column) -> tuple[Column, Column]:
    angle = hour * F.lit(2 * math.pi / 24)
    return F.sin(angle), F.cos(angle)


def first_non_empty(*columns: Column) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def indicator(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("long")


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def ratio(numerator: Column, denominator: Column, when_zero: Column | float | None = 0.0) -> Column:
    """Quotient with a stated value for a denominator that is zero, negative or null."""
    fallback = when_zero if isinstance(when_zero, Column) else F.lit(when_zero).cast("double")
    return F.when(denominator > 0, numerator / denominator).otherwise(fallback)


def one_row(df: DataFrame, **aggregates: Column) -> Column:
    """Aggregates of ``df`` as a struct-valued scalar subquery (computed once, no join)."""
    row = df.agg(*[expr.alias(name) for name, expr in aggregates.items()])
    return row.select(F.struct(*aggregates)).scalar()


def with_missing(df: DataFrame, names: Iterable[str], default: Column) -> DataFrame:
    return df.withColumns({n: default for n in names if n not in df.columns})
