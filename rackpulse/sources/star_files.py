"""Star-schema files: Parquet and CSV export, relationship manifest, typed CSV read-back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rackpulse.operators.star import RELATIONSHIPS
from rackpulse.schemas import STAR
from rackpulse.session import work_path

# Row meaning of each table in the manifest.
GRAIN = {
    "fact_events": "raw event",
    "fact_incidents": "correlated incident",
    "fact_hourly_kpi": "fleet hour",
    "fact_clusters": "root-cause family",
    "dim_fleet": "node",
    "dim_time": "tick",
}


def write_parquet_star(tables: dict[str, DataFrame], root: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}.parquet")


def write_csv_star(tables: dict[str, DataFrame], root: str) -> None:
    """Header CSV per table; null and the empty string stay apart, so reading back restores the rows."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).option("nullValue", "\\N").option("escape", '"').csv(
            f"{root}/{name}.csv"
        )


def write_manifest(spark: SparkSession, root: str) -> None:
    """Tables and many-to-one relationships as JSON rows."""
    tables = [(name, f"{name}.csv", grain) for name, grain in GRAIN.items()]
    spark.createDataFrame(tables, "table string, file string, grain string").coalesce(1).write.mode("overwrite").json(
        f"{root}/tables.json"
    )
    relations = [(f"{f}.{k}", f"{d}.{o}", "many-to-one") for f, k, d, o in RELATIONSHIPS]
    spark.createDataFrame(relations, "left string, right string, type string").coalesce(1).write.mode("overwrite").json(
        f"{root}/relationships.json"
    )


def export(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> str:
    """Parquet and CSV star. The CSV copy is taken from the Parquet files, so each table is computed once."""
    write_parquet_star(tables, root)
    stored = {name: spark.read.schema(STAR[name]).parquet(f"{root}/{name}.parquet") for name in tables}
    write_csv_star(stored, root)
    write_manifest(spark, root)
    return root


def export_to_work_dir(spark: SparkSession, tables: dict[str, DataFrame]) -> str:
    return export(spark, tables, work_path(spark, "star"))


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One CSV table with its declared types; a value that does not fit its type fails the read."""
    return (
        spark.read.schema(STAR[table])
        .option("header", True)
        .option("nullValue", "\\N")
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_csv_star(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: read_csv(spark, f"{root}/{name}.csv", name) for name in STAR}
