"""Versioned models: Spark ML directories, their tables, and an append-only index of versions."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from rackpulse.operators.boosting import BoostedTrees
from rackpulse.operators.drift import fingerprint

INDEX = "version long, created_at string, data_rows long, data_hash string, n_features long, metadata string"


def _index(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(INDEX).json(f"{root}/index")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def next_version(spark: SparkSession, root: str) -> int:
    index = _index(spark, root)
    return 1 if index is None else (index.agg(F.max("version")).first()[0] or 0) + 1


def claim_version(spark: SparkSession, root: str) -> int:
    """The next version that nobody else has taken: the file that claims it can be created by one writer only."""
    version = next_version(spark, root)
    while True:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/claims/v{version}")
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(place):
            return version
        version += 1


def register(
    spark: SparkSession,
    root: str,
    models: dict,
    dataset: DataFrame,
    features: list[str],
    tables: dict[str, DataFrame] | None = None,
    **metadata,
) -> str:
    """Save models and tables as the next version; the index row is written last and makes the version visible."""
    version = claim_version(spark, root)
    folder = f"{root}/v{version}"
    for name, model in models.items():
        model.write().overwrite().save(f"{folder}/{name}")
    for name, df in (tables or {}).items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    mark = fingerprint(dataset).first()
    document = {**metadata, "feature_names": list(features), "models": sorted(models), "tables": sorted(tables or {})}
    row = (
        version,
        datetime.now(UTC).isoformat(),
        mark["rows"],
        f"{mark['content_xor'] & (2**64 - 1):016x}",
        len(features),
        json.dumps(document, default=str),
    )
    spark.createDataFrame([row], INDEX).coalesce(1).write.mode("append").json(f"{root}/index")
    return folder


def latest(spark: SparkSession, root: str) -> Row | None:
    """Index row of the newest version, or None."""
    index = _index(spark, root)
    return None if index is None else index.orderBy(F.desc("version")).first()


def load_latest(spark: SparkSession, root: str, loaders: dict) -> dict | None:
    """Newest version: its metadata, its models through the given loader classes, and its tables."""
    row = latest(spark, root)
    if row is None:
        return None
    folder = f"{root}/v{row['version']}"
    metadata = json.loads(row["metadata"])
    return {
        "version": row["version"],
        "data_hash": row["data_hash"],
        "metadata": metadata,
        "models": {name: loaders[name].load(f"{folder}/{name}") for name in metadata["models"] if name in loaders},
        "tables": {name: spark.read.parquet(f"{folder}/{name}") for name in metadata["tables"]},
    }


def register_risk_model(spark: SparkSession, root: str, model, dataset: DataFrame, tables: dict[str, DataFrame] | None = None, **metadata) -> str:
    """The next version of a risk model: its trees and, if it has one, its calibration curve."""
    parts = {"classifier": model.classifier} | ({"calibration": model.calibration} if model.calibration is not None else {})
    return register(spark, root, parts, dataset, model.features, tables, **metadata)


def load_risk_model(spark: SparkSession, root: str) -> tuple[int, object] | None:
    """Version and risk model that :func:`register_risk_model` stored last; its calibrated scores are the original's."""
    from rackpulse.operators.risk import RiskModel

    loaded = load_latest(spark, root, {"classifier": BoostedTrees, "calibration": IsotonicRegressionModel})
    if loaded is None:
        return None
    models = loaded["models"]
    return loaded["version"], RiskModel(models["classifier"], loaded["metadata"]["feature_names"], models.get("calibration"))
