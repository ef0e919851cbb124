"""Labels and rankings of root-cause families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.functions.columns import hour_of_day
from rackpulse.schemas import TICKS_PER_HOUR

NOISE = -1
NOISE_LABEL = "noise / unclustered"


def label_clusters(clustered: DataFrame, ticks_per_hour: int = TICKS_PER_HOUR) -> DataFrame:
    """One label per cluster: modal kind, scope and severity, peak hour and size; ties go to the smallest value.

    ``mode`` keeps one counter per distinct value, and all four columns have small fixed domains.
    """

    def modal(column):
        return F.mode(column, deterministic=True)

    hour = hour_of_day(F.col("opened_tick"), ticks_per_hour)
    groups = clustered.groupBy("cluster_id").agg(
        modal("root_kind").alias("kind"),
        modal("scope").alias("scope"),
        modal("severity_max").alias("severity"),
        modal(hour).alias("hour"),
        F.count("*").alias("size"),
    )
    text = F.format_string("%s · %s · %s · ~%02d:00 (%d×)", "kind", "scope", "severity", "hour", "size")
    return groups.select(
        "cluster_id", F.when(F.col("cluster_id") == NOISE, NOISE_LABEL).otherwise(text).alias("cluster_label")
    )


def with_labels(clustered: DataFrame) -> DataFrame:
    """Incidents with the label of their cluster; the label table has one row per cluster."""
    return clustered.join(label_clusters(clustered), "cluster_id", "left")


def top_recurring(clustered: DataFrame, n: int = 10) -> DataFrame:
    """Largest families without noise."""
    return (
        clustered.filter(F.col("cluster_id") != NOISE)
        .groupBy("cluster_id", "cluster_label")
        .agg(
            F.count("*").alias("count"),
            F.count_if(F.col("severity_max") == "critical").alias("critical_count"),
            F.avg(F.col("all_benign").cast("double")).alias("all_benign_ratio"),
            F.avg("member_count").alias("mean_members"),
        )
        .orderBy(F.desc("count"), "cluster_id")
        .limit(n)
    )


def cluster_counts(clustered: DataFrame) -> DataFrame:
    """Clusters, noise rows and rows in one line."""
    return clustered.agg(
        F.countDistinct(F.when(F.col("cluster_id") != NOISE, F.col("cluster_id"))).alias("clusters"),
        F.count_if(F.col("cluster_id") == NOISE).alias("noise"),
        F.count("*").alias("incidents"),
    )
