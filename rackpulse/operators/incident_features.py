"""Numeric description of incidents for clustering."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.functions.columns import cyclical, hour_of_day, severity_rank
from rackpulse.schemas import KINDS, SCOPES, TICKS_PER_HOUR

FEATURES = (
    *[f"kind_{k}" for k in KINDS],
    *[f"scope_{s}" for s in SCOPES],
    "log_member_count",
    "duration_ticks",
    "severity",
    "hod_sin",
    "hod_cos",
    "all_benign",
)


def featurize(incidents: DataFrame, ticks_per_hour: int = TICKS_PER_HOUR, keep: tuple[str, ...] = ("incident_id",)) -> DataFrame:
    """Twenty numeric columns per incident in one projection."""
    sine, cosine = cyclical(hour_of_day(F.col("opened_tick"), ticks_per_hour))

    def hot(column: str, value: str):
        return F.coalesce(F.col(column) == value, F.lit(False)).cast("double")

    return incidents.select(
        *keep,
        *[hot("root_kind", k).alias(f"kind_{k}") for k in KINDS],
        *[hot("scope", s).alias(f"scope_{s}") for s in SCOPES],
        F.log1p("member_count").alias("log_member_count"),
        F.coalesce(F.col("duration_ticks").cast("double"), F.lit(0.0)).alias("duration_ticks"),
        severity_rank(F.col("severity_max")).cast("double").alias("severity"),
        sine.alias("hod_sin"),
        cosine.alias("hod_cos"),
        F.col("all_benign").cast("double").alias("all_benign"),
    )


def as_vector(features: DataFrame, columns: tuple[str, ...] = FEATURES, output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=output).transform(features)
