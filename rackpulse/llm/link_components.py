"""Connected components of links by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.llm.scope import WorkTables


def _large_star(links: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest node around."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them. Links come as (larger, smaller)."""
    least = links.groupBy("a").agg(F.min("b").alias("low"))
    moved = links.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b"))
    return moved.filter("a <> b").distinct()


def _forked(links: DataFrame) -> bool:
    """Whether some node has two links to smaller ones."""
    return not links.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def link_components(links: DataFrame) -> DataFrame:
    """Rows (node, component) of the nodes of ``links`` (a, b); a component is named by its smallest node.

    Rounds of large and small stars until every link leads to a node without a smaller one: about log2 of the longest path
    squared at most, a handful in practice. Minima are combined before the shuffle and a hub's links are spread by skew
    splitting, as each link meets one row. Every half round is written and the one before removed. Loops, repeated and
    reversed links are allowed, nulls are left out; no links make no rows.
    """
    with WorkTables(links.sparkSession) as work:
        start = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        now = work.write(start, "links")
        while not now.join(now.select(F.col("a").alias("b")), "b", "left_semi").isEmpty() or _forked(now):
            large = work.write(_large_star(now), "large-star")
            work.drop(now)
            now = work.write(_small_star(large), "small-star")
            work.drop(large)
        work.keep(now)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
