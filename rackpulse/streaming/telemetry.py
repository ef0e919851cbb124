"""Streaming ingest of landing folders.

A stream has no "first sample of the batch", so ticks count from a fixed epoch and the unit of utilisation is stated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.schemas import TICKS_PER_HOUR
from rackpulse.sources import exporter, matrix, otlp
from rackpulse.sources.canonical import SIGNAL_COLUMNS, as_metrics, finish, tick_of


def listing_stream(spark: SparkSession, path: str) -> DataFrame:
    """Monitor listings, line by line."""
    return finish(exporter.parse_listing(spark.readStream.text(path)))


def exporter_csv_stream(
    spark: SparkSession, path: str, header: list[str], epoch: float, percent: bool = True
) -> DataFrame:
    """Exporter CSV files with the given header."""
    schema = ", ".join(f"`{name}` string" for name in header)
    raw = spark.readStream.schema(schema).option("header", True).csv(path)
    return finish(exporter.parse_csv(raw, percent), origin=F.lit(epoch))


def _wide(samples: DataFrame, seconds, epoch: float, delay: str, percent: bool, ticks_per_hour: int) -> DataFrame:
    """One row per (time, GPU) once the watermark has passed it."""
    timed = samples.withColumn("at", F.timestamp_micros((seconds * 1_000_000).cast("long"))).withWatermark("at", delay)
    cells = {
        c: F.max_by(F.when(F.col("metric") == c, F.col("value")), F.when(F.col("metric") == c, F.col("ord")))
        for c in SIGNAL_COLUMNS
    }
    wide = timed.groupBy("at", "gpu_id", "node_id").agg(*[e.alias(c) for c, e in cells.items()])
    return as_metrics(
        wide.withColumns(
            {
                "gpu_sm_util": F.col("gpu_sm_util") / (100.0 if percent else 1.0),
                "tick": tick_of(F.unix_micros("at") / 1_000_000, F.lit(epoch), ticks_per_hour),
                "rack_id": F.lit(None),
                "zone_id": F.lit(None),
            }
        )
    )


def range_query_stream(
    spark: SparkSession, path: str, epoch: float, delay: str = "10 minutes", percent: bool = True,
    ticks_per_hour: int = TICKS_PER_HOUR,
) -> DataFrame:
    """Range-query responses, one JSON document per line."""
    samples = matrix.series_samples(spark.readStream.text(path))
    return _wide(samples, F.col("ts"), epoch, delay, percent, ticks_per_hour)


def otlp_stream(
    spark: SparkSession, path: str, epoch: float, delay: str = "10 minutes", percent: bool = True,
    ticks_per_hour: int = TICKS_PER_HOUR,
) -> DataFrame:
    """OTLP exports, one JSON document per line."""
    samples = otlp.point_samples(spark.readStream.text(path))
    return _wide(samples, F.col("ts_ns") / 1_000_000_000, epoch, delay, percent, ticks_per_hour)
