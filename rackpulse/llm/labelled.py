"""Labelled texts for the model fits, bounded before they reach the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known_labels(labels: DataFrame, label: str, usable: Column, key: str) -> DataFrame:
    """Distinct rows (key, label) of the labels 0 and 1 for which ``usable`` holds."""
    rows = labels.filter(usable & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    return rows.filter(F.col("label").isin(0, 1)).distinct()


def class_sizes(known: DataFrame) -> dict[int, int]:
    return {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}


def labelled_texts(docs: DataFrame, known: DataFrame, per_class: int, key: str, text: str) -> DataFrame:
    """Rows (key, hash, label, text): documents with their label in ``known``; ``hash`` is of the text.

    Equal texts of one key are one row, however often the document is repeated. Of each class ``per_class`` rows are kept,
    those with the smallest hash of the key, then of the text; only they are joined with their texts.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("key is not null").withColumn("hash", F.xxhash64("text"))
    pairs = rows.select("key", "hash").distinct().join(known, "key")
    chosen = None
    for value in (0, 1):
        own = pairs.filter(F.col("label") == value).orderBy(F.xxhash64("key"), "key", "hash").limit(per_class)
        chosen = own if chosen is None else chosen.unionByName(own)
    # At most 2 * per_class rows of three numbers are broadcast; repeated texts fold before the exchange.
    return rows.join(F.broadcast(chosen), ["key", "hash"]).groupBy("key", "hash", "label").agg(F.first("text").alias("text"))
