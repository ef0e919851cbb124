"""OpenTelemetry metrics in JSON: resource -> scope -> metric -> data point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.functions.columns import first_non_empty
from rackpulse.schemas import TICKS_PER_HOUR
from rackpulse.sources.canonical import pivot_last

# Metric names and the columns they fill.
METRIC_COLUMNS = {
    "gpu.temperature": "gpu_temp_c",
    "gpu.power.draw": "gpu_power_w",
    "gpu.utilization": "gpu_sm_util",
    "gpu.memory.ecc.errors.corrected": "ecc_corrected_total",
    "gpu.nvlink.crc.errors": "nvlink_crc_total",
    "gpu.pcie.replay.count": "pcie_aer_total",
}

_ATTRIBUTES = (
    "array<struct<key: string, value: struct<stringValue: string, intValue: string, doubleValue: string, boolValue: string>>>"
)
_POINTS = f"struct<dataPoints: array<struct<attributes: {_ATTRIBUTES}, timeUnixNano: string, asDouble: string, asInt: string>>>"
PAYLOAD = (
    f"resourceMetrics array<struct<resource: struct<attributes: {_ATTRIBUTES}>, scopeMetrics: array<struct<"
    f"metrics: array<struct<name: string, gauge: {_POINTS}, sum: {_POINTS}>>>>>>"
)


def attribute_map(attributes: Column) -> Column:
    """Key/value list as a map of strings: the first present value type counts, a repeated key keeps its last value."""

    def is_last(entry: Column, index: Column) -> Column:
        later = F.slice(attributes, index + 2, F.greatest(F.size(attributes), F.lit(1)))
        return ~F.exists(later, lambda other: other["key"] == entry["key"])

    def text(value: Column) -> Column:
        return F.coalesce(value["stringValue"], value["intValue"], value["doubleValue"], value["boolValue"])

    entries = F.transform(F.filter(attributes, is_last), lambda a: F.struct(a["key"], text(a["value"])))
    return F.map_from_entries(entries)


def point_samples(payloads: DataFrame) -> DataFrame:
    """Long samples (ts_ns, gpu_id, node_id, metric, value, ord) from JSON texts in column ``value``."""
    columns = F.create_map(*[F.lit(x) for pair in METRIC_COLUMNS.items() for x in pair])

    def attribute(source: str, name: str) -> Column:
        return F.try_element_at(source, F.lit(name))

    resources = payloads.select(F.xxhash64("value").alias("payload"), F.from_json("value", PAYLOAD).alias("p")).select(
        "payload", F.posexplode("p.resourceMetrics").alias("rp", "r")
    )
    scopes = resources.select(
        "payload", "rp", attribute_map(F.col("r.resource.attributes")).alias("ra"), F.posexplode("r.scopeMetrics").alias("sp", "s")
    )
    metrics = scopes.select("payload", "rp", "ra", "sp", F.posexplode("s.metrics").alias("mp", "m")).withColumn(
        "metric", F.try_element_at(columns, F.col("m.name"))
    )
    points = F.when(F.size("m.gauge.dataPoints") > 0, F.col("m.gauge.dataPoints")).otherwise(F.col("m.sum.dataPoints"))
    exploded = metrics.filter("metric is not null").select(
        "payload", "rp", "ra", "sp", "mp", "metric", F.posexplode(points).alias("dp", "d")
    )
    node = F.coalesce(
        first_non_empty(*[attribute("ra", n) for n in ("host.name", "k8s.node.name", "service.instance.id")]),
        F.lit("node-unknown"),
    )
    named = exploded.withColumn("da", attribute_map(F.col("d.attributes"))).select(
        F.coalesce(F.col("d.timeUnixNano").try_cast("long"), F.lit(0).cast("long")).alias("ts_ns"),
        node.alias("node_id"),
        F.coalesce(first_non_empty(attribute("da", "gpu.id"), attribute("da", "gpu")), F.lit("0")).alias("gpu"),
        "metric",
        F.coalesce(F.col("d.asDouble").try_cast("double"), F.col("d.asInt").try_cast("double")).alias("value"),
        F.struct("payload", "rp", "sp", "mp", "dp").alias("ord"),
    )
    return named.filter(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("gpu_id", F.concat("node_id", F.lit("/gpu"), "gpu"))


def parse_otlp(payloads: DataFrame, ticks_per_hour: int = TICKS_PER_HOUR, origin: Column | None = None) -> DataFrame:
    return pivot_last(point_samples(payloads), "ts_ns", F.col("ts_ns") / 1_000_000_000, origin, ticks_per_hour)


def read_otlp(
    spark: SparkSession, path: str, ticks_per_hour: int = TICKS_PER_HOUR, origin: Column | None = None
) -> DataFrame:
    """Canonical metrics from export files, one JSON document per file."""
    return parse_otlp(spark.read.text(path, wholetext=True), ticks_per_hour, origin)
