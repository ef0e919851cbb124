"""Feature drift: baseline quantile edges, population stability index, batch fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.functions.ordered import exact_quantiles
from rackpulse.session import cut_lineage

# Floor of a bin share, gap between forced edges, and the drift classes.
SHARE_FLOOR = 1e-6
EDGE_GAP = 1e-9
MODERATE, SIGNIFICANT = 0.10, 0.25


def melt(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form (feature, value)."""
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]
    return df.select(F.inline(F.array(*pairs)))


def baseline_edges(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Strictly increasing quantile edges ``q0..qN``, one row per feature."""
    quantiles = exact_quantiles(melt(df, columns), "value", [i / bins for i in range(bins + 1)], by=["feature"])

    def append(edges, value):
        previous = F.element_at(edges, -1)
        bumped = F.when(value <= previous, previous + EDGE_GAP).otherwise(value)
        return F.concat(edges, F.array(F.when(F.size(edges) == 0, value).otherwise(bumped)))

    fixed = quantiles.select(
        "feature", F.aggregate("quantiles", F.array().cast("array<double>"), append).alias("edges")
    )
    return fixed.select("feature", *[F.col("edges")[i].alias(f"q{i}") for i in range(bins + 1)])


def _edge_arrays(edges: DataFrame) -> DataFrame:
    names = [c for c in edges.columns if c.startswith("q")]
    return edges.select("feature", F.array(*names).alias("edges"))


def bin_shares(df: DataFrame, edges: DataFrame) -> DataFrame:
    """Share of every bin per feature: [a, b), the last bin closed, values outside the edges ignored.

    The edge table has one row per feature column, so broadcasting it is safe at any data size; joining on the few
    feature names instead would shuffle all values onto as many tasks.
    """
    columns = [r["feature"] for r in edges.select("feature").collect() if r["feature"] in df.columns]
    arrays = _edge_arrays(edges).filter(F.col("feature").isin(columns))
    last = F.size("edges") - 2
    binned = (
        melt(df, columns)
        .join(F.broadcast(arrays), "feature")
        .filter((F.col("value") >= F.col("edges")[0]) & (F.col("value") <= F.element_at("edges", -1)))
        .withColumn("bin", F.least(F.size(F.filter("edges", lambda e: e <= F.col("value"))) - 1, last))
        .groupBy("feature", "bin")
        .agg(F.count("*").alias("n"))
    )
    grid = arrays.select("feature", F.explode(F.sequence(F.lit(0), last)).alias("bin"))
    counted = grid.join(binned, ["feature", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    totals = counted.groupBy("feature").agg(F.sum("n").alias("total"))
    return counted.join(totals, "feature").select(
        "feature", "bin", (F.col("n") / F.greatest("total", F.lit(1))).alias("share")
    )


def psi_of_shares(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Index and class per feature from two share tables; the reference may be a stored one."""
    floor = F.lit(SHARE_FLOOR)
    pairs = reference.withColumnRenamed("share", "r").join(
        current.withColumnRenamed("share", "c"), ["feature", "bin"]
    )
    r, c = F.greatest("r", floor), F.greatest("c", floor)
    scored = pairs.groupBy("feature").agg(F.sum((c - r) * F.log(c / r)).alias("psi"))
    severity = F.when(F.col("psi") < MODERATE, "stable").when(F.col("psi") < SIGNIFICANT, "moderate")
    return scored.withColumn("severity", severity.otherwise("significant")).orderBy(F.desc("psi"), "feature")


def psi_report(baseline: DataFrame, current: DataFrame, edges: DataFrame) -> DataFrame:
    """Drift of every feature present in both tables, worst first."""
    edges = cut_lineage(edges)
    return psi_of_shares(bin_shares(baseline, edges), bin_shares(current, edges))


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-independent content hash of a data set in one pass."""
    row = F.xxhash64(*df.columns)
    return df.agg(
        F.count("*").alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.sha2(F.lit(df.schema.simpleString()), 256).alias("schema_hash"),
        F.coalesce(F.bit_xor(row), F.lit(0)).alias("content_xor"),
        F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("content_sum"),
    )
