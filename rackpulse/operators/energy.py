"""GPU utilisation to power, energy, idle cost and efficiency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackpulse.functions.columns import count_where, node_of_gpu, ratio

# Power model of one GPU and one node, idle threshold and energy price.
GPU_TDP_WATTS = 700.0
IDLE_SHARE = 0.3
LOAD_SHARE = 0.7
NODE_OVERHEAD_WATTS = 600.0
GPU_PEAK_TFLOPS = 1000.0
IDLE_THRESHOLD = 0.05
PRICE_PER_KWH = 0.06


def gpu_watts(util: Column) -> Column:
    return F.lit(GPU_TDP_WATTS) * (F.lit(IDLE_SHARE) + F.lit(LOAD_SHARE) * util)


def node_power(util: DataFrame) -> DataFrame:
    """Watts per (node, tick): overhead plus its GPUs."""
    return util.groupBy(node_of_gpu(F.col("gpu_id")).alias("node_id"), "tick").agg(
        (F.lit(NODE_OVERHEAD_WATTS) + F.sum(gpu_watts(F.col("util")))).alias("watts")
    )


def idle_kwh(idle_samples: Column) -> Column:
    """Energy of idle hourly samples."""
    return idle_samples * IDLE_SHARE * GPU_TDP_WATTS / 1000


def idle_dollars(kwh: Column, price_per_kwh: float = PRICE_PER_KWH) -> Column:
    return kwh * price_per_kwh


def pue(facility_kw: Column, it_kw: Column) -> Column:
    return ratio(facility_kw, it_kw)


def renewable_match(renewable_kwh: Column, total_kwh: Column) -> Column:
    return F.least(F.lit(1.0), ratio(renewable_kwh, total_kwh))


def hourly_kpi(
    util: DataFrame, gpus_per_node: int = 8, idle_threshold: float = IDLE_THRESHOLD
) -> DataFrame:
    """Fleet power, GPU-hours, active and idle GPUs per tick from one aggregate over the samples."""
    per_tick = util.groupBy("tick").agg(
        F.avg("util").alias("mean_util"),
        F.count("util").alias("gpu_count"),
        count_where(F.col("util") > IDLE_THRESHOLD).alias("active_gpu_count"),
        F.sum("util").alias("gpu_hours"),
        count_where(F.col("util") < idle_threshold).alias("idle_gpu_count"),
    )
    nodes = F.bround(F.col("gpu_count") / gpus_per_node)
    gpu_total = gpu_watts(F.col("mean_util")) * F.col("gpu_count")
    return per_tick.select(
        "tick",
        ((gpu_total + nodes * NODE_OVERHEAD_WATTS) / 1000).alias("fleet_kw"),
        "active_gpu_count",
        "gpu_hours",
        "idle_gpu_count",
    )


def power_timeseries(util: DataFrame, gpus_per_node: int = 8) -> DataFrame:
    return hourly_kpi(util, gpus_per_node).select(
        "tick", "fleet_kw", "active_gpu_count", F.col("gpu_hours").alias("gpu_hours_in_tick")
    )


def idle_by_tick(util: DataFrame, idle_threshold: float = IDLE_THRESHOLD) -> DataFrame:
    return hourly_kpi(util, idle_threshold=idle_threshold).select("tick", "idle_gpu_count")


def energy_summary(
    util: DataFrame,
    gpus_per_node: int = 8,
    idle_threshold: float = IDLE_THRESHOLD,
    price_per_kwh: float = PRICE_PER_KWH,
) -> DataFrame:
    """Seven energy scalars in one row; the samples are scanned once and reduced per tick first."""
    per_tick = (
        util.groupBy("tick")
        .agg(
            F.avg("util").alias("mean_util"),
            F.count("util").alias("gpu_count"),
            F.sum("util").alias("gpu_hours"),
            F.sum(F.when(F.col("util") >= idle_threshold, F.col("util"))).alias("active_hours"),
            count_where(F.col("util") < idle_threshold).alias("idle"),
        )
        .withColumn(
            "fleet_kw",
            (
                gpu_watts(F.col("mean_util")) * F.col("gpu_count")
                + F.bround(F.col("gpu_count") / gpus_per_node) * NODE_OVERHEAD_WATTS
            )
            / 1000,
        )
    )
    total = per_tick.agg(
        F.sum("fleet_kw").alias("total_kwh"),
        idle_kwh(F.sum("idle")).alias("idle_kwh"),
        F.coalesce(F.sum("active_hours"), F.lit(0.0)).alias("active_gpu_hours"),
        F.sum("gpu_hours").alias("total_gpu_hours"),
        F.avg("fleet_kw").alias("avg_fleet_kw"),
    )
    return total.filter(F.col("total_kwh").isNotNull()).select(
        "total_kwh",
        "idle_kwh",
        idle_dollars(F.col("idle_kwh"), price_per_kwh).alias("idle_waste_dollars"),
        "active_gpu_hours",
        "total_gpu_hours",
        "avg_fleet_kw",
        ratio(F.col("total_gpu_hours") * GPU_PEAK_TFLOPS, F.col("total_kwh") * 1000).alias("perf_per_watt_tflops"),
    )


def perf_per_watt(gpu_hours: Column, power_kw: Column) -> Column:
    """TFLOPS per watt over an aggregate of GPU-hours and kW."""
    return ratio(F.sum(gpu_hours * GPU_PEAK_TFLOPS), F.sum(power_kw) * 1000)


def hourly_gpu_hours(util: DataFrame, *by: str) -> DataFrame:
    return util.groupBy(*by, "tick").agg(F.sum("util").alias("value"))


def mean_utilisation(util: DataFrame) -> DataFrame:
    return util.groupBy("tick").agg(F.avg("util").alias("util"))
