"""Common last step of the telemetry readers: ticks, GPU and node ids, topology, declared columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackpulse.functions.columns import compose_gpu_id, node_of_gpu
from rackpulse.operators.topology import attach_topology
from rackpulse.schemas import METRICS, TICKS_PER_HOUR

# Exporter metric names and the columns they fill.
EXPORTER_COLUMNS = {
    "DCGM_FI_DEV_GPU_TEMP": "gpu_temp_c",
    "DCGM_FI_DEV_POWER_USAGE": "gpu_power_w",
    "DCGM_FI_DEV_GPU_UTIL": "gpu_sm_util",
    "DCGM_FI_DEV_ECC_SBE_VOL_TOTAL": "ecc_corrected_total",
    "DCGM_FI_DEV_NVLINK_CRC_FLIT_ERROR_COUNT_TOTAL": "nvlink_crc_total",
    "DCGM_FI_DEV_PCIE_REPLAY_COUNTER": "pcie_aer_total",
}
SIGNAL_COLUMNS = tuple(EXPORTER_COLUMNS.values())
PERCENT_ABOVE = 1.5


def tick_of(seconds: Column, origin: Column, ticks_per_hour: int = TICKS_PER_HOUR) -> Column:
    """Sample interval nearest to a time, halves to the even one."""
    return F.rint((seconds - origin) / (3600 / ticks_per_hour)).cast("long")


def as_metrics(df: DataFrame) -> DataFrame:
    """Exactly the declared columns and types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in METRICS.fields])


def empty_default(name: str) -> Column:
    """Value of a column the feed does not have: 0 for counters, utilisation and power, null for the rest."""
    return F.lit(0 if "total" in name or "util" in name or name.endswith("_w") else None)


def finish(
    df: DataFrame, fleet: DataFrame | None = None, origin: Column | None = None, ticks_per_hour: int = TICKS_PER_HOUR
) -> DataFrame:
    """Canonical metrics from a parsed feed with any of ``ts`` (seconds), ``gpu_id``, ``node_id``, ``gpu_idx``.

    Without an origin the first time of the batch is tick 0; pass one to load consecutive batches on a common axis.
    """
    if "ts" in df.columns:
        start = origin if origin is not None else df.agg(F.min("ts")).scalar()
        df = df.withColumn("_origin", start).withColumn("tick", tick_of(F.col("ts"), F.col("_origin"), ticks_per_hour))
    else:
        df = df.withColumn("tick", F.lit(0))
    if "gpu_id" not in df.columns and "gpu_idx" in df.columns:
        node = F.col("node_id") if "node_id" in df.columns else F.lit(None).cast("string")
        df = df.withColumn("gpu_id", compose_gpu_id(node, F.col("gpu_idx")))
    if "node_id" not in df.columns:
        df = df.withColumn("node_id", node_of_gpu(F.col("gpu_id")))
    if fleet is not None:
        df = attach_topology(df.drop("rack_id", "zone_id"), fleet, ("rack_id", "zone_id"))
    else:
        df = df.withColumns({"rack_id": F.lit(None), "zone_id": F.lit(None)})
    missing = [f.name for f in METRICS.fields if f.name not in df.columns]
    return as_metrics(df.withColumns({name: empty_default(name) for name in missing}))


def pivot_last(
    samples: DataFrame, time: str, seconds: Column, origin: Column | None = None, ticks_per_hour: int = TICKS_PER_HOUR
) -> DataFrame:
    """Wide metrics from (time, gpu_id, node_id, metric, value, ord): per cell the last value in payload order.

    Utilisation is divided by 100 when the batch holds percentages. A signal without any sample in the batch is 0
    everywhere, a missing cell of a present signal stays null.
    """
    wide = samples.groupBy(time, "gpu_id", "node_id").agg(
        *[
            F.max_by(
                F.when(F.col("metric") == c, F.col("value")), F.when(F.col("metric") == c, F.col("ord"))
            ).alias(c)
            for c in SIGNAL_COLUMNS
        ]
    )
    facts = wide.agg(
        F.min(seconds).alias("start"),
        F.max("gpu_sm_util").alias("top_util"),
        *[F.count(c).alias(f"n_{c}") for c in SIGNAL_COLUMNS],
    )
    batch = facts.select(F.struct("*")).scalar()
    percent = F.when(F.col("_b.top_util") > PERCENT_ABOVE, 100.0).otherwise(1.0)
    start = origin if origin is not None else F.col("_b.start")
    known = wide.withColumn("_b", batch).withColumn("gpu_sm_util", F.col("gpu_sm_util") / percent)
    filled = {c: F.when(F.col(f"_b.n_{c}") == 0, F.lit(0.0)).otherwise(F.col(c)) for c in SIGNAL_COLUMNS}
    return as_metrics(
        known.withColumns(filled).withColumns(
            {
                "tick": tick_of(seconds, start, ticks_per_hour),
                "rack_id": F.lit(None),
                "zone_id": F.lit(None),
            }
        )
    )
