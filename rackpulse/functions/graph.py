"""Connected components by iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.session import cut_lineage


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Label every ``id`` with the smallest id it is connected to.

    ``edges`` holds (src, dst) in both directions. Each round takes the smallest neighbouring label and then the label
    of that label, so long chains collapse in a logarithmic number of rounds. Every round is checkpointed: the plan
    stays short and a lost executor costs one round at most.
    """
    edges = cut_lineage(edges)
    labels = cut_lineage(vertices.select("id", F.col("id").alias("label")))
    while True:
        nearest = (
            edges.join(labels, edges["dst"] == labels["id"])
            .groupBy(F.col("src").alias("id"))
            .agg(F.min("label").alias("near"))
        )
        hooked = labels.join(nearest, "id", "left").select(
            "id", F.col("label").alias("before"), F.least("label", F.coalesce("near", "label")).alias("label")
        )
        parents = labels.select(F.col("id").alias("label"), F.col("label").alias("above"))
        jumped = cut_lineage(
            hooked.join(parents, "label", "left").select(
                "id", "before", F.least("label", F.coalesce("above", "label")).alias("label")
            )
        )
        labels = jumped.select("id", "label")
        if jumped.filter("label <> before").isEmpty():
            return labels
