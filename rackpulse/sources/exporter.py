"""GPU exporter files: whitespace monitor listings and header CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.schemas import TICKS_PER_HOUR
from rackpulse.sources.canonical import EXPORTER_COLUMNS, PERCENT_ABOVE, SIGNAL_COLUMNS, finish

# Header names that mean the same column.
ALIASES = {
    **EXPORTER_COLUMNS,
    "Hostname": "node_id",
    "hostname": "node_id",
    "host": "node_id",
    "GPU-Id": "gpu_idx",
    "gpu": "gpu_idx",
    "timestamp": "ts",
    "Timestamp": "ts",
}


def parse_listing(lines: DataFrame) -> DataFrame:
    """Rows of a monitor listing from text lines (column ``value``); works on a stream as well.

    Header, comment and blank lines, and rows with a malformed number, are left out.
    """
    line = F.col("value")
    parts = F.split(F.trim(F.translate(line, "\t", " ")), "\\s+")
    useful = ~(line.startswith("#") | line.contains("Entity") | line.contains("GPU-Id"))
    rows = (
        lines.filter(useful)
        .select(parts.alias("p"))
        .filter((F.size("p") >= 7) & F.col("p")[0].isin("GPU", "gpu"))
    )

    def number(index: int, kind: str) -> Column:
        return F.get("p", F.lit(index)).try_cast(kind)

    fields = {
        "gpu_idx": number(1, "int"),
        "gpu_sm_util": number(2, "double") / 100.0,
        "gpu_power_w": number(3, "double"),
        "gpu_temp_c": number(4, "double"),
        "ecc_corrected_total": number(5, "long"),
        "nvlink_crc_total": number(6, "long"),
        "pcie_aer_total": F.when(F.size("p") > 7, number(7, "long")).otherwise(F.lit(0).cast("long")),
    }
    return rows.select(*[expr.alias(name) for name, expr in fields.items()]).na.drop()


def parse_csv(raw: DataFrame, percent: bool | None = None) -> DataFrame:
    """Header CSV, read as strings, with canonical names and types.

    ``percent`` states the unit of utilisation; without it the largest value of the batch decides.
    """
    df = raw.withColumnsRenamed({old: new for old, new in ALIASES.items() if old in raw.columns})
    counters = [c for c in SIGNAL_COLUMNS if c.endswith("_total") and c in df.columns]
    levels = [c for c in SIGNAL_COLUMNS if not c.endswith("_total") and c in df.columns]
    df = df.withColumns(
        {
            **{c: F.col(c).try_cast("double") for c in levels},
            **{c: F.col(c).try_cast("double").cast("long") for c in counters},
        }
    )
    if "ts" in df.columns:
        df = df.withColumn("ts", F.unix_micros(F.col("ts").try_cast("timestamp")) / 1_000_000)
    if "gpu_sm_util" in df.columns:
        if percent is None:
            top = df.agg(F.max("gpu_sm_util").alias("top")).scalar()
            df = df.withColumn("_top", top)
            scale = F.when(F.col("_top") > PERCENT_ABOVE, 100.0).otherwise(1.0)
        else:
            scale = F.lit(100.0 if percent else 1.0)
        df = df.withColumn("gpu_sm_util", F.col("gpu_sm_util") / scale).drop("_top")
    return df


def looks_like_csv(spark: SparkSession, path: str) -> bool:
    """Whether the first non-blank line holds a comma; reads one line."""
    first = spark.read.text(path).filter(F.trim("value") != "").first()
    return first is not None and "," in first["value"]


def read_exporter(
    spark: SparkSession,
    path: str,
    fleet: DataFrame | None = None,
    ticks_per_hour: int = TICKS_PER_HOUR,
    origin: Column | None = None,
) -> DataFrame:
    """Canonical metrics from exporter files of either format under ``path`` (one format per path)."""
    if looks_like_csv(spark, path):
        parsed = parse_csv(spark.read.option("header", True).csv(path))
    else:
        parsed = parse_listing(spark.read.text(path))
    return finish(parsed, fleet, origin, ticks_per_hour)
