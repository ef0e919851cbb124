"""Z-scores with population deviation; a column without spread keeps scale 1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One-row table ``mean`` and ``scale``, both structs keyed by column."""
    deviation = {c: F.coalesce(F.stddev_pop(c), F.lit(0.0)) for c in columns}
    return df.agg(
        F.struct(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns]).alias("mean"),
        F.struct(*[F.when(deviation[c] > 1e-12, deviation[c]).otherwise(1.0).alias(c) for c in columns]).alias("scale"),
    )


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace the columns by their z-scores; the fit enters as a scalar subquery."""
    fit = scaler.select(F.struct("mean", "scale")).scalar()
    scaled = {c: (F.col(c) - F.col(f"_fit.mean.{c}")) / F.col(f"_fit.scale.{c}") for c in columns}
    return df.withColumn("_fit", fit).withColumns(scaled).drop("_fit")


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return apply_scaler(df, fit_scaler(df, columns), columns)


def standardise_vectors(df: DataFrame, column: str) -> DataFrame:
    """Per-dimension z-scores of an array column, fitted on all rows."""
    per_dimension = (
        df.select(F.posexplode(column).alias("pos", "v"))
        .groupBy("pos")
        .agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    )
    fit = per_dimension.agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "std")))).scalar()

    def z(value: Column, at: Column) -> Column:
        return (value - at["mean"]) / F.when(at["std"] > 1e-12, at["std"]).otherwise(1.0)

    return df.withColumn("_fit", fit).withColumn(column, F.zip_with(column, "_fit", z)).drop("_fit")
