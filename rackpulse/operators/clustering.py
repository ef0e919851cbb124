"""Recurring root-cause families of incidents."""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rackpulse.functions.columns import hour_of_day, severity_rank
from rackpulse.functions.graph import connected_components
from rackpulse.functions.scaling import standardise
from rackpulse.operators.families import NOISE, with_labels
from rackpulse.operators.incident_features import FEATURES, as_vector, featurize
from rackpulse.schemas import TICKS_PER_HOUR
from rackpulse.session import cut_lineage

SIZE_STEPS = 4
BLOCK = ("root_kind", "scope", "rank", "all_benign")
POINT = (*BLOCK, "hod", "size_step", "duration")


def _with_point(incidents: DataFrame, ticks_per_hour: int) -> DataFrame:
    return incidents.withColumns(
        {
            "rank": severity_rank(F.col("severity_max")),
            "hod": hour_of_day(F.col("opened_tick"), ticks_per_hour),
            "size_step": F.round(F.log1p("member_count") * SIZE_STEPS).cast("long"),
            "duration": F.coalesce("duration_ticks", F.lit(0).cast("long")),
        }
    )


def density_clusters(
    incidents: DataFrame,
    min_cluster_size: int = 8,
    eps: float = 0.5,
    ticks_per_hour: int = TICKS_PER_HOUR,
) -> DataFrame:
    """Incidents with ``cluster_id``: density clustering (DBSCAN*) in standardised feature space, -1 for noise.

    Incidents collapse to weighted points of a lattice: kind, scope, severity, benign flag, opening hour, duration in
    ticks and log size in quarter steps. The lattice is finite, so from here on the work depends on the variety of
    incidents and not on their number, and a family holding a third of all incidents is one heavy point. A point is
    core when at least ``min_cluster_size`` incidents lie within ``eps`` of it; families are the connected components
    of core points. Standardised one-hot, benign and severity steps are at least 1 long, hence with ``eps < 1``
    neighbours always share those four values and the neighbour search is an equi-join on them plus a grid over hour,
    size and duration.
    """
    if not 0 < eps < 1:
        raise ValueError("eps must lie in (0, 1)")
    placed = _with_point(incidents, ticks_per_hour)
    points = cut_lineage(
        placed.groupBy(*POINT).agg(F.count("*").alias("weight")).withColumn("id", F.concat_ws("|", *POINT))
    )
    spread = _spread(incidents, ticks_per_hour)
    pairs = _neighbours(points, spread, eps)
    dense = pairs.groupBy("src").agg(F.sum("weight").alias("near")).filter(F.col("near") >= min_cluster_size)
    core = cut_lineage(points.join(dense.select(F.col("src").alias("id")), "id", "left_semi").select("id", "weight"))
    links = (
        pairs.select("src", "dst")
        .join(core.select(F.col("id").alias("src")), "src", "left_semi")
        .join(core.select(F.col("id").alias("dst")), "dst", "left_semi")
        .filter("src <> dst")
    )
    labels = connected_components(core, links)
    families = (
        labels.join(core, "id")
        .groupBy("label")
        .agg(F.sum("weight").alias("size"))
        .filter(F.col("size") >= min_cluster_size)
        # One row per family; the lattice bounds their number.
        .select("label", (F.row_number().over(W.orderBy("label")) - 1).cast("long").alias("cluster_id"))
    )
    assigned = points.select("id", *POINT).join(labels.join(families, "label").select("id", "cluster_id"), "id", "left")
    keys = [placed[c].eqNullSafe(assigned[c]) for c in POINT]
    joined = placed.join(assigned, keys, "left")
    return joined.select(
        *[placed[c] for c in incidents.columns], F.coalesce("cluster_id", F.lit(NOISE).cast("long")).alias("cluster_id")
    )


def _spread(incidents: DataFrame, ticks_per_hour: int) -> dict[str, float]:
    """Population deviations of the four ordered features: one aggregate, four numbers."""
    dims = ("log_member_count", "duration_ticks", "hod_sin", "hod_cos")
    row = featurize(incidents, ticks_per_hour).agg(*[F.stddev_pop(d).alias(d) for d in dims]).first()
    return {d: row[d] if row[d] and row[d] > 1e-12 else 1.0 for d in dims}


def _hour_gap(spread: dict[str, float], a: int, b: int) -> float:
    turn = 2 * math.pi / 24
    return (
        ((math.sin(a * turn) - math.sin(b * turn)) / spread["hod_sin"]) ** 2
        + ((math.cos(a * turn) - math.cos(b * turn)) / spread["hod_cos"]) ** 2
    )


def _neighbours(points: DataFrame, spread: dict[str, float], eps: float) -> DataFrame:
    """Ordered pairs of lattice points within ``eps``, each point also with itself."""
    gaps = [[_hour_gap(spread, a, b) for b in range(24)] for a in range(24)]
    near_hours = F.array(
        *[
            F.array(*[F.struct(F.lit(b).cast("long").alias("hour"), F.lit(g).alias("gap")) for b, g in enumerate(row)
                      if g <= eps * eps])
            for row in gaps
        ]
    )
    size_scale = 1 / (SIZE_STEPS * spread["log_member_count"])
    size_cell = lambda step: F.floor(step * size_scale / eps)
    time_cell = lambda ticks: F.floor(ticks / (spread["duration_ticks"] * eps))
    around = F.array(*[F.lit(d).cast("long") for d in (-1, 0, 1)])

    right = points.select(
        F.col("id").alias("dst"), *BLOCK, "hod", F.col("size_step").alias("size_b"), F.col("duration").alias("time_b"),
        "weight", size_cell(F.col("size_step")).alias("size_cell"), time_cell(F.col("duration")).alias("time_cell"),
    )
    left = (
        points.select(
            F.col("id").alias("src"), *BLOCK, F.element_at(near_hours, F.col("hod").cast("int") + 1).alias("hours"),
            F.col("size_step").alias("size_a"), F.col("duration").alias("time_a"),
        )
        .select("*", F.inline("hours"))
        .withColumn("size_step", F.explode(around))
        .withColumn("time_step", F.explode(around))
        .select(
            "src", *BLOCK, F.col("hour").alias("hod"), "gap", "size_a", "time_a",
            (size_cell(F.col("size_a")) + F.col("size_step")).alias("size_cell"),
            (time_cell(F.col("time_a")) + F.col("time_step")).alias("time_cell"),
        )
    )
    distance = (
        F.col("gap")
        + F.pow((F.col("size_a") - F.col("size_b")) * size_scale, F.lit(2.0))
        + F.pow((F.col("time_a") - F.col("time_b")) / spread["duration_ticks"], F.lit(2.0))
    )
    return cut_lineage(
        left.join(right, [*BLOCK, "hod", "size_cell", "time_cell"])
        .filter(distance <= eps * eps)
        .select("src", "dst", "weight")
    )


def cluster_incidents(incidents: DataFrame, min_cluster_size: int = 8, eps: float = 0.5) -> DataFrame:
    """Incidents with family id and readable family label."""
    clustered = with_labels(density_clusters(incidents, min_cluster_size, eps))
    return clustered.select(*incidents.columns, "cluster_id", "cluster_label")


def kmeans_clusters(incidents: DataFrame, k: int = 8, seed: int = 42, max_iter: int = 20) -> DataFrame:
    """Centroid families for a fixed number of them."""
    features = as_vector(standardise(featurize(incidents), FEATURES)).select("incident_id", "features")
    model = KMeans(k=k, seed=seed, maxIter=max_iter, predictionCol="cluster_id").fit(features)
    return model.transform(features).select("incident_id", "cluster_id")


def silhouette(incidents: DataFrame, cluster_id: Column | str = "cluster_id") -> DataFrame:
    """Mean silhouette of non-noise incidents with squared Euclidean distances; null when it is not defined.

    Squared distances need only per-cluster sums, one pass over the rows, where plain distances need all pairs.
    """
    spark = incidents.sparkSession
    column = F.col(cluster_id) if isinstance(cluster_id, str) else cluster_id
    kept = incidents.withColumn("_c", column).filter(F.col("_c") != NOISE)
    sizes = kept.agg(F.count("*").alias("n"), F.countDistinct("_c").alias("k")).first()
    score = None
    if sizes["n"] >= 3 and sizes["k"] >= 2:
        scaled = standardise(featurize(kept, keep=("_c",)), FEATURES)
        evaluator = ClusteringEvaluator(predictionCol="_c", featuresCol="features", distanceMeasure="squaredEuclidean")
        score = evaluator.evaluate(as_vector(scaled).withColumn("_c", F.col("_c").cast("int")))
    return spark.range(1).select(F.lit(score).cast("double").alias("silhouette"))
