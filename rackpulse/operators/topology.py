"""Fleet layout from node ordinals, and topology enrichment of events and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.functions.columns import floor_div, node_of_target
from rackpulse.schemas import TOPOLOGY

NODES_PER_RACK = 5
RACKS_PER_ZONE = 20
FEEDS_PER_ZONE = 2
SPINES = 2
NULL_KEY_SALTS = 512


def padded(number: Column, width: int) -> Column:
    """Zero-padded to ``width`` digits; longer numbers keep all their digits."""
    text = number.cast("string")
    return F.when(number < 10**width, F.lpad(text, width, "0")).otherwise(text)


def node_name(ordinal: Column) -> Column:
    return F.concat(F.lit("node-"), padded(ordinal, 4))


def zone_name(ordinal: Column, nodes_per_rack: int = NODES_PER_RACK, racks_per_zone: int = RACKS_PER_ZONE) -> Column:
    return F.concat(F.lit("zone-"), floor_div(ordinal, nodes_per_rack * racks_per_zone).cast("string"))


def place_nodes(
    ids: DataFrame,
    ordinal: str,
    nodes_per_rack: int = NODES_PER_RACK,
    racks_per_zone: int = RACKS_PER_ZONE,
    feeds_per_zone: int = FEEDS_PER_ZONE,
    spines: int = SPINES,
) -> DataFrame:
    """Add node, rack, zone, feed and spine ids to a table of node ordinals."""
    rack = floor_div(F.col(ordinal), nodes_per_rack)
    zone = zone_name(F.col(ordinal), nodes_per_rack, racks_per_zone)
    feed = (rack % racks_per_zone) % feeds_per_zone
    return ids.select(
        ordinal,
        node_name(F.col(ordinal)).alias("node_id"),
        F.concat(F.lit("rack-"), padded(rack, 3)).alias("rack_id"),
        zone.alias("zone_id"),
        F.concat(zone, F.lit("/feed-"), feed.cast("string")).alias("feed_id"),
        F.concat(F.lit("spine-"), (rack % spines).cast("string")).alias("spine_id"),
    )


def build_fleet(spark: SparkSession, n_nodes: int = 500, gpus_per_node: int = 8, **layout: int) -> DataFrame:
    """Default fleet layout with a GPU count per node."""
    placed = place_nodes(spark.range(n_nodes).withColumnRenamed("id", "ordinal"), "ordinal", **layout)
    return placed.drop("ordinal").withColumn("gpus", F.lit(gpus_per_node).cast("long"))


def fleet_slice(fleet: DataFrame, *, zone: str | None = None, rack: str | None = None, feed: str | None = None) -> DataFrame:
    """Nodes of one zone, rack or feed."""
    for column, value in (("zone_id", zone), ("rack_id", rack), ("feed_id", feed)):
        if value is not None:
            fleet = fleet.filter(F.col(column) == value)
    return fleet


def gpus_by(fleet: DataFrame, *keys: str, gpus_per_node: int = 8) -> DataFrame:
    """Node and GPU totals for the whole fleet or per key."""
    return fleet.groupBy(*keys).agg(
        F.count("*").alias("nodes"), (F.count("*") * gpus_per_node).alias("total_gpus")
    )


def attach_topology(rows: DataFrame, fleet: DataFrame, columns: tuple[str, ...] = TOPOLOGY) -> DataFrame:
    """Left join on ``node_id``.

    No broadcast is forced: Catalyst broadcasts the fleet when its measured size is under the session's threshold and
    otherwise runs a sort-merge join whose hot nodes adaptive execution splits. Rows without a node would all meet in
    one partition of that join, so their join key is replaced by spread-out values that match nothing.
    """
    spread = F.concat(F.lit("~"), F.pmod(F.xxhash64(*rows.columns), F.lit(NULL_KEY_SALTS)).cast("string"))
    dim = fleet.select(F.col("node_id").alias("_node"), *columns)
    return (
        rows.withColumn("_key", F.coalesce(F.col("node_id"), spread))
        .join(dim, F.col("_key") == F.col("_node"), "left")
        .drop("_key", "_node")
    )


def enrich_with_topology(events: DataFrame, fleet: DataFrame) -> DataFrame:
    """Events with node, rack, zone, feed and spine; a zone-scope event belongs to the zone it names."""
    placed = attach_topology(events.withColumn("node_id", node_of_target(F.col("target"))), fleet)
    zone = F.when(F.col("scope") == "zone", F.col("target")).otherwise(F.col("zone_id"))
    return placed.withColumn("zone_id", zone)
