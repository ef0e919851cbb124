"""The generic test tables seen as fleet telemetry.

Event rows become failure events, line items become GPU utilisation samples, orders become service tickets. Node, rack,
zone, feed and spine follow from the node ordinal exactly as in :func:`rackpulse.operators.topology.place_nodes`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rackpulse.functions.columns import floor_div, node_of_gpu
from rackpulse.operators.topology import node_name, place_nodes, zone_name
from rackpulse.schemas import SECONDS_PER_TICK

EVENT_ORIGIN = "timestamp_ntz'2024-01-01'"
UTIL_ORIGIN = "1995-01-01"
DEDUPE_WINDOW = 36
BURST_WINDOW = 15

KIND_OF = {
    "click": "thermal_throttle",
    "view": "nvlink_fault",
    "error": "ecc_uncorrectable",
    "purchase": "pcie_error",
    "signup": "cooling_failure",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "events").select("user_id").distinct()
    return place_nodes(ids, "user_id").drop("user_id")


def _seconds() -> Column:
    return F.expr(f"timestampdiff(SECOND, {EVENT_ORIGIN}, ts)")


def _k() -> Column:
    return F.regexp_extract("props", "([0-9]+)", 1).cast("int")


def as_events(raw: DataFrame) -> DataFrame:
    """Raw event rows as failure events; works on a static or a streaming frame."""
    user, kind = F.col("user_id"), F.col("event_type")
    zone = zone_name(user)
    scope = (
        F.when(kind == "signup", "zone").when(kind.isin("click", "error"), "gpu").otherwise("node")
    )
    target = (
        F.when(kind == "signup", zone)
        .when(kind.isin("click", "error"), F.concat(node_name(user), F.lit("/gpu"), F.col("event_id") % 8))
        .otherwise(node_name(user))
    )
    kinds = F.create_map(*[F.lit(x) for pair in KIND_OF.items() for x in pair])
    severity = F.when(F.col("value") >= 100, "critical").when(F.col("value") >= 40, "warn").otherwise("info")
    cascades = ((kind == "signup") & (_k() < 50)) | ((kind == "click") & (_k() < 10))
    parent = F.concat(F.lit("cooling-"), zone, F.lit("-"), floor_div(_seconds(), 86400).cast("string"))
    return raw.select(
        "event_id",
        "ts",
        floor_div(_seconds(), SECONDS_PER_TICK).alias("tick"),
        kinds[kind].alias("kind"),
        scope.alias("scope"),
        target.alias("target"),
        severity.alias("severity"),
        (severity == "info").alias("benign"),
        F.when(cascades, parent).alias("parent_event_id"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_events(table(spark, sf_dir, "events")).drop("ts")


def utilization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One utilisation sample per (day, GPU); quantities are whole numbers, so the mean is exact."""
    rows = table(spark, sf_dir, "lineitem").select(
        (F.lit(12) * F.datediff(F.to_date("l_shipdate"), F.lit(UTIL_ORIGIN).cast("date"))).cast("long").alias("tick"),
        F.concat(node_name(F.col("l_suppkey")), F.lit("/gpu"), F.col("l_linenumber") % 8).alias("gpu_id"),
        (F.col("l_quantity") - 1).alias("q"),
    )
    return rows.groupBy("tick", "gpu_id").agg((F.sum("q") / F.count("q") / 49).alias("util"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample per (GPU, tick): peak levels and the running error, view and purchase counts.

    The collapse to one row per tick is a partial aggregate; after it a GPU has at most 288 rows a day however many raw
    rows it had, which bounds the running sum below.
    """
    node = node_name(F.col("user_id"))
    kind = F.col("event_type")
    per_tick = (
        table(spark, sf_dir, "events")
        .select(
            floor_div(_seconds(), SECONDS_PER_TICK).alias("tick"),
            F.concat(node, F.lit("/gpu"), F.col("event_id") % 2).alias("gpu_id"),
            "value",
            _k().alias("k"),
            *[(kind == name).cast("long").alias(name) for name in ("error", "view", "purchase")],
        )
        .groupBy("gpu_id", "tick")
        .agg(
            F.max("value").alias("gpu_temp_c"),
            F.max("k").alias("k"),
            *[F.sum(name).alias(name) for name in ("error", "view", "purchase")],
        )
    )
    so_far = W.partitionBy("gpu_id").orderBy("tick").rowsBetween(W.unboundedPreceding, W.currentRow)
    return per_tick.select(
        "tick",
        "gpu_id",
        node_of_gpu(F.col("gpu_id")).alias("node_id"),
        "gpu_temp_c",
        (F.lit(210.0) + F.lit(4.9) * F.col("k")).alias("gpu_power_w"),
        (F.col("k") / 100).alias("gpu_sm_util"),
        F.sum("error").over(so_far).alias("ecc_corrected_total"),
        F.sum("view").over(so_far).alias("nvlink_crc_total"),
        F.sum("purchase").over(so_far).alias("pcie_aer_total"),
    )


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as service tickets: opened at the order date, resolved at the last ship date."""
    shipped = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.max("l_shipdate").alias("resolved_at"), F.min("l_shipdate").alias("first_ship"))
    )
    return (
        table(spark, sf_dir, "orders")
        .join(shipped, "o_orderkey", "left")
        .select(
            F.col("o_orderkey").alias("ticket_id"),
            F.col("o_orderpriority").alias("priority"),
            F.expr("o_orderdate - make_interval(0,0,0,0,(o_orderkey % 24),0,0)").alias("event_at"),
            F.col("o_orderdate").alias("opened_at"),
            "resolved_at",
            (F.col("o_orderstatus") == "P").alias("reopened"),
        )
    )
