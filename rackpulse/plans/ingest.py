"""Ingest queries: the test metrics are written in each feed format by Spark and read back through the readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.plans import adapters as A
from rackpulse.plans.ctes import FLEET, METRICS, sql
from rackpulse.plans.kpi import rounded
from rackpulse.session import work_path
from rackpulse.sources import exporter, matrix, otlp
from rackpulse.sources.canonical import EXPORTER_COLUMNS, SIGNAL_COLUMNS

EPOCH = 1704067200
LEVELS = ("gpu_temp_c", "gpu_power_w", "gpu_sm_util")


def _gpu_index() -> Column:
    return F.substring_index("gpu_id", "gpu", -1)


def _seconds() -> Column:
    return F.col("tick") * 300 + EPOCH


def listing_lines(metrics: DataFrame) -> DataFrame:
    """Monitor listing of the metrics; where the temperature in cents is divisible by 7 the power is unreadable."""
    power = F.when(F.pmod(F.round(F.col("gpu_temp_c") * 100).cast("long"), F.lit(7)) == 0, "N/A").otherwise(
        F.col("gpu_power_w").cast("string")
    )
    return metrics.select(
        F.concat_ws(
            "   ", F.lit("GPU"), _gpu_index(), F.round(F.col("gpu_sm_util") * 100).cast("int"), power, "gpu_temp_c",
            "ecc_corrected_total", "nvlink_crc_total", "pcie_aer_total",
        ).alias("value")
    )


def exporter_table(metrics: DataFrame) -> DataFrame:
    names = {column: name for name, column in EXPORTER_COLUMNS.items()}
    percent = F.round(F.col("gpu_sm_util") * 100)
    return metrics.select(
        F.date_format(F.timestamp_seconds(_seconds()), "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.col("node_id").alias("Hostname"),
        _gpu_index().alias("GPU-Id"),
        *[(percent if c == "gpu_sm_util" else F.col(c)).alias(names[c]) for c in SIGNAL_COLUMNS],
    )


def matrix_payloads(metrics: DataFrame) -> DataFrame:
    """One successful response per node, with a series per metric and GPU and one unknown metric."""
    names = {column: name for name, column in EXPORTER_COLUMNS.items()} | {"tick": "unknown_metric"}
    points = [
        F.struct(
            F.lit(name).alias("name"),
            (F.round(F.col("gpu_sm_util") * 100) if c == "gpu_sm_util" else F.col(c)).cast("string").alias("value"),
        )
        for c, name in names.items()
    ]
    series = (
        metrics.select("node_id", "gpu_id", _seconds().alias("s"), F.inline(F.array(*points)))
        .groupBy("node_id", "gpu_id", "name")
        .agg(F.array_sort(F.collect_list(F.array(F.col("s").cast("string"), F.col("value")))).alias("values"))
    )
    labels = F.create_map(
        F.lit("__name__"), F.col("name"), F.lit("hostname"), F.col("node_id"), F.lit("gpu"), _gpu_index()
    )
    return (
        series.groupBy("node_id")
        .agg(F.collect_list(F.struct(labels.alias("metric"), "values")).alias("result"))
        .select(F.to_json(F.struct(F.lit("success").alias("status"), F.struct("result").alias("data"))).alias("value"))
    )


def otlp_payloads(metrics: DataFrame) -> DataFrame:
    """One export document per node: levels as gauges with doubles, counters as sums with integers."""
    names = {column: name for name, column in otlp.METRIC_COLUMNS.items()}

    def point(column: str) -> Column:
        value = F.col(column)
        return F.struct(
            F.array(F.struct(F.lit("gpu.id").alias("key"), F.struct(_gpu_index().alias("intValue")).alias("value")))
            .alias("attributes"),
            (_seconds() * 1_000_000_000).cast("string").alias("timeUnixNano"),
            (value if column in LEVELS else F.lit(None)).cast("double").alias("asDouble"),
            (F.lit(None) if column in LEVELS else value).cast("string").alias("asInt"),
        )

    per_node = metrics.groupBy("node_id").agg(*[F.collect_list(point(c)).alias(c) for c in SIGNAL_COLUMNS])

    def metric(column: str) -> Column:
        points = F.struct(F.col(column).alias("dataPoints"))
        nothing = F.lit(None).cast(per_node.select(points.alias("p")).schema["p"].dataType)
        gauge = column in LEVELS
        return F.struct(
            F.lit(names[column]).alias("name"),
            (points if gauge else nothing).alias("gauge"),
            (nothing if gauge else points).alias("sum"),
        )

    attributes = F.array(
        F.struct(F.lit("host.name").alias("key"), F.struct(F.col("node_id").alias("stringValue")).alias("value"))
    )
    scope = F.array(F.struct(F.array(*[metric(c) for c in SIGNAL_COLUMNS]).alias("metrics")))
    resource = F.struct(F.struct(attributes.alias("attributes")).alias("resource"), scope.alias("scopeMetrics"))
    return per_node.select(F.to_json(F.struct(F.array(resource).alias("resourceMetrics"))).alias("value"))


def _rounded(df: DataFrame) -> DataFrame:
    return rounded(df, 6, *LEVELS)


def dmon_rows(spark: SparkSession, sf: str) -> DataFrame:
    path = work_path(spark, "listing")
    listing_lines(A.metrics(spark, sf)).write.text(path)
    return _rounded(exporter.read_exporter(spark, path))


def exporter_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = work_path(spark, "exporter")
    exporter_table(A.metrics(spark, sf)).write.option("header", True).csv(path)
    return _rounded(exporter.read_exporter(spark, path, A.fleet(spark, sf)))


def matrix_json(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(matrix.parse_range_query(matrix_payloads(A.metrics(spark, sf))))


def otlp_json(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(otlp.parse_otlp(otlp_payloads(A.metrics(spark, sf))))


QUERIES = {
    "dmon_rows": dmon_rows,
    "exporter_csv": exporter_csv,
    "matrix_json": matrix_json,
    "otlp_json": otlp_json,
}

_VALUES = """round(gpu_temp_c, 6) as gpu_temp_c, round(gpu_power_w, 6) as gpu_power_w, round(gpu_sm_util, 6) as gpu_sm_util,
  ecc_corrected_total, nvlink_crc_total, pcie_aer_total"""
_TICK = "tick - (select min(tick) from metrics) as tick, gpu_id"

ORACLES = {
    "dmon_rows": sql(
        METRICS,
        f"""select 0::bigint as tick, 'node-unknown/' || split_part(gpu_id, '/', 2) as gpu_id, 'node-unknown' as node_id,
  null::varchar as rack_id, null::varchar as zone_id, {_VALUES}
from metrics where cast(round(gpu_temp_c * 100) as bigint) % 7 <> 0""",
    ),
    "exporter_csv": sql(
        f"{METRICS},{FLEET}",
        f"select {_TICK}, m.node_id, rack_id, zone_id, {_VALUES} from metrics m left join fleet f on f.node_id = m.node_id",
    ),
    "matrix_json": sql(
        METRICS, f"select {_TICK}, node_id, null::varchar as rack_id, null::varchar as zone_id, {_VALUES} from metrics"
    ),
    "otlp_json": sql(
        METRICS, f"select {_TICK}, node_id, null::varchar as rack_id, null::varchar as zone_id, {_VALUES} from metrics"
    ),
}
