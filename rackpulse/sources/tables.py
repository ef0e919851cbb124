"""Declared-schema readers of the telemetry tables and writers of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse import schemas

TABLES = {
    "events": schemas.EVENTS,
    "fleet": schemas.FLEET,
    "utilization": schemas.UTILIZATION,
    "metrics": schemas.METRICS,
}


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One telemetry table; a missing file fails with Spark's path error. Filters and columns reach the scan."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}.parquet")


def write_metrics(metrics: DataFrame, path: str, ticks_per_day: int = 288) -> None:
    """Metrics partitioned by day, so that a time range reads only its own folders."""
    metrics.withColumn("day", F.floor(F.col("tick") / ticks_per_day)).write.mode("overwrite").partitionBy("day").parquet(
        path
    )


def latest_window(dataset: DataFrame, tick: str = "window_end_tick") -> DataFrame:
    """Rows of the last window."""
    last = dataset.agg(F.max(tick).alias("last")).scalar()
    return dataset.withColumn("_last", last).filter(F.col(tick) == F.col("_last")).drop("_last")


def write_latest_window(dataset: DataFrame, path: str) -> None:
    latest_window(dataset).write.mode("overwrite").parquet(path)


def write_result(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Small result tables (leaderboard, importance, metrics) as header CSV or JSON lines."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.json(path)


def scoring_input(df: DataFrame, features: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Model columns in model order: absent or null features become 0, other columns are dropped."""
    return df.select(
        *keep,
        *[
            (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)).alias(c)
            for c in features
        ],
    )
