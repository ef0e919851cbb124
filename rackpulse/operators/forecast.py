"""Trend plus daily-cycle forecast and the capacity questions asked of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackpulse.functions.columns import day_bucket, hour_of_day
from rackpulse.schemas import TICKS_PER_HOUR

# Shortest series that is decomposed, and the width of the interval in standard deviations.
MIN_POINTS = 24
BAND = 1.28


def forecast(
    series: DataFrame,
    horizon_hours: int = 24,
    ticks_per_hour: int = TICKS_PER_HOUR,
    by: Sequence[str] = (),
) -> DataFrame:
    """Forecast of ``(tick, value)``, one series or one per key.

    Linear trend over daily means, mean residual per hour of day, and the spread of what is left. Everything is
    computed for all series at once; a series has one row per tick, so its size is bounded by time.
    """
    keys = list(by) or ["_series"]
    if not by:
        series = series.withColumn("_series", F.lit("all"))
    points = series.select(
        *keys, "tick", "value", hour_of_day(F.col("tick"), ticks_per_hour).alias("hod"),
        day_bucket(F.col("tick"), ticks_per_hour).alias("day"),
    )
    levels = [
        F.count("value").alias("n"), F.max("tick").alias("last_tick"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
    ]
    # Without keys an empty series still gets its flat row, hence the ungrouped aggregate.
    sizes = points.groupBy(*keys).agg(*levels) if by else points.agg(*levels).withColumn("_series", F.lit("all"))
    trend = _trend(points, keys, 24 * ticks_per_hour)
    cycle = _cycle(points.join(trend, keys), keys)
    fitted = sizes.join(trend, keys, "left").join(cycle, keys, "left")

    decomposed = F.col("n") >= MIN_POINTS
    last = F.coalesce("last_tick", F.lit(0).cast("long"))
    stride = F.when(decomposed, ticks_per_hour).otherwise(1).cast("long")
    future = fitted.withColumn(
        "tick", F.explode(F.sequence(last + stride, last + stride * horizon_hours, stride))
    )
    diurnal = F.coalesce(F.element_at("diurnal", hour_of_day(F.col("tick"), ticks_per_hour)), F.lit(0.0))
    mean = F.coalesce("mean", F.lit(0.0))
    spread = F.when(F.col("n") > 1, F.col("std")).otherwise(mean * 0.1)
    projected = F.greatest(F.col("slope") * F.col("tick") + F.col("intercept") + diurnal, F.lit(0.0))
    low = F.greatest(F.col("yhat") - BAND * F.col("sigma"), F.lit(0.0))
    return (
        future.withColumn("yhat", F.when(decomposed, projected).otherwise(mean))
        .select(
            *by,
            "tick",
            "yhat",
            F.when(decomposed, low).otherwise(mean - BAND * spread).alias("yhat_lower"),
            F.when(decomposed, F.col("yhat") + BAND * F.col("sigma")).otherwise(mean + BAND * spread)
            .alias("yhat_upper"),
        )
    )


def _trend(points: DataFrame, keys: list[str], ticks_per_day: int) -> DataFrame:
    """Slope per tick and intercept of the daily means; a single day has slope 0."""
    daily = points.groupBy(*keys, "day").agg(F.avg("value").alias("m"))
    return daily.groupBy(*keys).agg(
        (F.coalesce(F.regr_slope("m", "day"), F.lit(0.0)) / ticks_per_day).alias("slope"),
        F.coalesce(F.regr_intercept("m", "day"), F.avg("m")).alias("intercept"),
    )


def _cycle(points: DataFrame, keys: list[str]) -> DataFrame:
    """Mean residual per hour of day, and the population deviation around those means.

    The remainder has mean zero inside every hour, so its variance is the size-weighted mean of the hourly variances.
    """
    residual = F.col("value") - (F.col("slope") * F.col("tick") + F.col("intercept"))
    hourly = points.groupBy(*keys, "hod").agg(
        F.count("*").alias("size"), F.avg(residual).alias("level"), F.var_pop(residual).alias("variance")
    )
    return hourly.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("hod", "level"))).alias("diurnal"),
        F.sqrt(F.sum(F.col("size") * F.col("variance")) / F.sum("size")).alias("sigma"),
    )


def threshold_crossing(
    predicted: DataFrame, capacity: Column | float, threshold: float = 0.85, by: Sequence[str] = ()
) -> DataFrame:
    """Ticks from the first forecast tick to the first at or over ``threshold * capacity``; null if it stays under."""
    limit = F.lit(threshold) * (capacity if isinstance(capacity, Column) else F.lit(float(capacity)))
    first_over = F.min(F.when(F.col("yhat") >= F.col("_limit"), F.col("tick")))
    return (
        predicted.withColumn("_limit", limit)
        .groupBy(*by)
        .agg((first_over - F.min("tick")).alias("ticks_to_threshold"))
    )


def weeks_of(ticks: Column, ticks_per_hour: int = 1) -> Column:
    """Weeks to exhaustion. The published figure divides ticks by the hours of a week, which is the default here;
    pass the real ticks per hour for calendar weeks."""
    return F.bround(ticks / (24 * 7 * ticks_per_hour), 2)


def headroom(used: Column, capacity: Column) -> Column:
    return F.when(capacity > 0, F.greatest(F.lit(0.0), F.lit(1.0) - used / capacity)).otherwise(F.lit(0.0))


def observed_and_forecast(observed: DataFrame, predicted: DataFrame) -> DataFrame:
    """Both series side by side per tick."""
    stacked = observed.select("tick", "value", F.lit("observed").alias("series")).unionByName(
        predicted.select("tick", F.col("yhat").alias("value"), F.lit("forecast").alias("series"))
    )
    return stacked.groupBy("tick").pivot("series", ["observed", "forecast"]).agg(F.first("value"))
