"""Global order statistics without ever sorting everything in one task.

A value range is cut into buckets at edges taken from a small uniform sample of the keys. Bucket totals are tiny and are
summed up on their own; rows are then ranked inside their bucket and shifted by the total before it. Results are exact
whatever the edges are; the edges only decide how even the tasks are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rackpulse.session import cut_lineage

MIN_BUCKETS = 8
SAMPLES_PER_BUCKET = 32
HASH_RANGE = 2**40


def bucket_count(df: DataFrame) -> int:
    """As many buckets as the session has shuffle partitions, so that a bucket stays of one task's size."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(wanted, MIN_BUCKETS)


def bucket_edges(keys: DataFrame, order: Sequence[str], buckets: int) -> list[tuple]:
    """Upper bounds of evenly filled buckets, from the keys whose hash falls below a threshold.

    Keys are distinct, so their hashes are even: the driver receives about ``buckets * SAMPLES_PER_BUCKET`` of them,
    however long the table is.
    """
    share = min(1.0, buckets * SAMPLES_PER_BUCKET / max(keys.count(), 1))
    sample = (
        keys.select(*order)
        .na.drop()
        .filter(F.pmod(F.xxhash64(*order), F.lit(HASH_RANGE)) < max(1, int(share * HASH_RANGE)))
        .collect()
    )
    ordered = sorted(tuple(row) for row in sample)
    if not ordered:
        return []
    return sorted({ordered[len(ordered) * i // buckets] for i in range(1, buckets)})


def with_bucket(df: DataFrame, order: Sequence[str], edges: list[tuple]) -> DataFrame:
    """Add ``_bucket``, the number of edges at or below the key; the mapping preserves the order.

    The edges come as one scalar subquery in two levels, so a row is compared with about 2 * sqrt(edges) of them.
    """
    if not edges:
        return df.withColumn("_bucket", F.lit(0))
    width = math.isqrt(len(edges) - 1) + 1
    blocks = [edges[i : i + width] for i in range(0, len(edges), width)]
    key = T.StructType([T.StructField(c, df.schema[c].dataType) for c in order])
    table = df.sparkSession.createDataFrame(
        [([b[0] for b in blocks], blocks)],
        T.StructType([T.StructField("heads", T.ArrayType(key)), T.StructField("blocks", T.ArrayType(T.ArrayType(key)))]),
    )

    def reached(bounds: Column) -> Column:
        return F.size(F.filter(bounds, lambda bound: bound <= F.col("_key")))

    block = F.col("_block")
    return (
        df.withColumns({"_edges": table.select(F.struct("heads", "blocks")).scalar(), "_key": F.struct(*order)})
        .withColumn("_block", reached(F.col("_edges.heads")))
        .withColumn(
            "_bucket",
            F.when(block > 0, (block - 1) * width + reached(F.element_at("_edges.blocks", block))).otherwise(0),
        )
        .drop("_edges", "_key", "_block")
    )


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    measures: Sequence[str],
    by: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Inclusive running sums ``cum_<measure>`` in the order (``by``, ``order``), restarting for each ``by``.

    The keys (``by``, ``order``) must be unique: group equal keys first. A busy ``by`` value covers many buckets. The
    input is read three times (sample, totals, ranks) and therefore checkpointed.
    """
    keys = [*by, *order]
    df = cut_lineage(df)
    bucketed = with_bucket(df, keys, bucket_edges(df, keys, buckets or bucket_count(df)))
    totals = bucketed.groupBy(*by, "_bucket").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    # At most `buckets` rows per group.
    earlier = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"_k_{c}") for c in by], F.col("_bucket").alias("_k_bucket"),
        *[F.coalesce(F.sum(f"_t_{m}").over(earlier), F.lit(0)).alias(f"_o_{m}") for m in measures],
    )
    inside = W.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = bucketed.withColumns({f"_s_{m}": F.sum(m).over(inside) for m in measures})
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by] + [F.col("_bucket") == F.col("_k_bucket")]
    return ranked.join(offsets, same).select(
        *df.columns, *[(F.col(f"_s_{m}") + F.col(f"_o_{m}")).alias(f"cum_{m}") for m in measures]
    )


def exact_quantiles(df: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles, one array column ``quantiles`` per group.

    Unlike the built-in exact percentile, no task holds all distinct values of a group. Rows without a group name form a group;
    groups without values have no row.
    """
    cells = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("_v"))
        .agg(F.count("*").alias("_n"))
    )
    ranked = running_totals(cells, ["_v"], ["_n"], by)
    sizes = cells.groupBy(*by).agg(F.sum("_n").alias("_size")) if by else cells.agg(F.sum("_n").alias("_size"))
    if by:
        # One row per group; the ranked cells of a group may be many, so only the small side is told apart by key.
        sizes = sizes.withColumnsRenamed({c: f"_k_{c}" for c in by})
        same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]
        ranked = ranked.join(sizes, same).drop(*[f"_k_{c}" for c in by])
    else:
        ranked = ranked.withColumn("_size", sizes.scalar())
    at = [F.lit(float(p)) * (F.col("_size") - 1) for p in probabilities]

    def reach(position: Column) -> Column:
        return F.min(F.when(F.col("cum__n") > position, F.col("_v")))

    picks = [F.struct(reach(F.floor(h)).alias("lo"), reach(F.ceil(h)).alias("hi")) for h in at]
    shares = [F.max(h - F.floor(h)) for h in at]
    blended = F.array(
        *[p["lo"] + (p["hi"] - p["lo"]) * share for p, share in zip(picks, shares, strict=True)]
    )
    return ranked.groupBy(*by).agg(blended.alias("quantiles"))
