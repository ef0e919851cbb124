"""The latest window stored for look-ups by node: bucketed and sorted by ``node_id``.

A point look-up reads one bucket. A table of requests is joined without moving the stored rows: only the distinct ids that
are asked for are exchanged, and rows of nodes nobody asked for never leave their bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "node_id"
BUCKETS = 64


def save(latest: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> None:
    """Store a snapshot as table ``name`` under ``path``, one sorted file per bucket. Rows without a node id are left out."""
    (
        latest.filter(F.col(KEY).isNotNull())
        .repartition(buckets, KEY)
        .write.bucketBy(buckets, KEY)
        .sortBy(KEY)
        .option("path", path)
        .saveAsTable(name)
    )


def attach(spark: SparkSession, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Declare a stored snapshot to another session, with the number of buckets it was written with."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {buckets} BUCKETS"
        f" LOCATION '{path}'"
    )
    return spark.table(name)


def row_of(table: DataFrame, node_id: str) -> DataFrame:
    """The stored rows of one node, none for an unknown one; the other buckets' files are not opened."""
    return table.filter(F.col(KEY) == node_id)


def look_up(table: DataFrame, requests: DataFrame, columns: list[str]) -> DataFrame:
    """Every request row with ``found`` and the stored ``columns`` of its node.

    Repeated requests are answered each. An unknown or null node id gives ``found`` false and null columns. If the snapshot
    holds several rows of a node, each is returned. Ids are made distinct before the look-up, so a node that a third of all
    requests ask for is looked up once; the answers then meet the requests in a join that adaptive execution broadcasts or
    splits. Request columns named like an answer column are refused.
    """
    clash = set(requests.columns) & {*columns, "found"}
    if clash:
        raise ValueError(f"request columns clash with answer columns: {sorted(clash)}")
    asked = requests.select(KEY).filter(F.col(KEY).isNotNull()).distinct()
    answers = table.select(KEY, *columns).join(asked, KEY, "left_semi").withColumn("found", F.lit(True))
    return requests.join(answers, KEY, "left").withColumn("found", F.coalesce("found", F.lit(False)))
