"""Range-query responses of a metrics server: JSON with one labelled series per metric and GPU."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.functions.columns import first_non_empty
from rackpulse.schemas import TICKS_PER_HOUR
from rackpulse.sources.canonical import EXPORTER_COLUMNS, pivot_last

PAYLOAD = (
    "status string, error string, data struct<result: array<struct<"
    "metric: map<string, string>, values: array<array<string>>>>>"
)


def series_samples(payloads: DataFrame) -> DataFrame:
    """Long samples (ts, gpu_id, node_id, metric, value, ord) from JSON texts in column ``value``.

    A response that does not report success fails the job; unknown metrics and unreadable points are left out.
    """
    parsed = payloads.select(F.xxhash64("value").alias("payload"), F.from_json("value", PAYLOAD).alias("p"))
    failure = F.raise_error(F.concat(F.lit("range query failed: "), F.coalesce("p.error", F.lit("unknown"))))
    result = F.when(F.col("p.status") == "success", F.col("p.data.result")).otherwise(failure)
    columns = F.create_map(*[F.lit(x) for pair in EXPORTER_COLUMNS.items() for x in pair])

    def label(name: str) -> Column:
        return F.try_element_at("s.metric", F.lit(name))

    series = parsed.select("payload", F.posexplode(result).alias("sp", "s")).select(
        "payload",
        "sp",
        F.try_element_at(columns, label("__name__")).alias("metric"),
        F.coalesce(first_non_empty(label("hostname"), label("Hostname")), label("instance"), F.lit("")).alias("node_id"),
        F.coalesce(first_non_empty(label("gpu"), label("GPU-Id")), F.lit("0")).alias("gpu"),
        F.posexplode("s.values").alias("vp", "v"),
    )
    return (
        series.select(
            F.get("v", F.lit(0)).try_cast("double").alias("ts"),
            F.concat("node_id", F.lit("/gpu"), "gpu").alias("gpu_id"),
            "node_id",
            "metric",
            F.get("v", F.lit(1)).try_cast("double").alias("value"),
            F.struct("payload", "sp", "vp").alias("ord"),
        )
        .filter("metric is not null and ts is not null and value is not null and not isnan(value)")
    )


def parse_range_query(
    payloads: DataFrame, ticks_per_hour: int = TICKS_PER_HOUR, origin: Column | None = None
) -> DataFrame:
    return pivot_last(series_samples(payloads), "ts", F.col("ts"), origin, ticks_per_hour)


def read_range_query(
    spark: SparkSession, path: str, ticks_per_hour: int = TICKS_PER_HOUR, origin: Column | None = None
) -> DataFrame:
    """Canonical metrics from response files, one response per file."""
    return parse_range_query(spark.read.text(path, wholetext=True), ticks_per_hour, origin)
