"""Failure-risk classifiers: training, calibration, scoring, explanation, comparison."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rackpulse.functions.ordered import running_totals
from rackpulse.operators import evaluation as E
from rackpulse.operators.boosting import BoostedTrees, HistogramTrees
from rackpulse.operators.window_features import LABEL
from rackpulse.session import cut_lineage, use_checkpoints

KEYS = ("window_end_tick", "node_id")

SEED = 42
CALIBRATION_SHARE = 0.2
CALIBRATION_ROWS = 10
SHUFFLE_BLOCK = 1000


@dataclass
class RiskModel:
    """A fitted classifier, its feature names and, where one could be fitted, its calibration curve."""

    classifier: Model
    features: list[str]
    calibration: IsotonicRegressionModel | None = None

    def raw(self, df: DataFrame, column: str = "raw_score") -> DataFrame:
        """Uncalibrated probability of failure from the feature columns."""
        packed = VectorAssembler(inputCols=self.features, outputCol="features").transform(df)
        return self.raw_of_vector(packed, column).drop("features")

    def raw_of_vector(self, df: DataFrame, column: str = "raw_score") -> DataFrame:
        scored = self.classifier.transform(df)
        internal = [c for c in scored.columns if c not in df.columns and c != "probability"]
        return scored.withColumn(column, vector_to_array("probability")[1]).drop("probability", *internal)

    def score(self, df: DataFrame, column: str = "score") -> DataFrame:
        """Calibrated probability, within [0, 1] by construction and checked."""
        scored = self.raw(df)
        if self.calibration is not None:
            scored = self.calibration.setPredictionCol("_calibrated").transform(scored)
            value = F.col("_calibrated")
        else:
            value = F.col("raw_score")
        inside = F.when((value >= 0) & (value <= 1), value).otherwise(F.raise_error("score outside [0, 1]"))
        return scored.withColumn(column, inside).drop("raw_score", "_calibrated")


def boosted_trees(**overrides) -> HistogramTrees:
    return HistogramTrees(**overrides)


def logistic(**overrides) -> Pipeline:
    """Linear reference model on standardised features."""
    scaler = StandardScaler(inputCol="features", outputCol="_scaled", withMean=True, withStd=True)
    return Pipeline(
        stages=[scaler, LogisticRegression(labelCol=LABEL, featuresCol="_scaled", weightCol="weight", **overrides)]
    )


def forest(**overrides) -> RandomForestClassifier:
    return RandomForestClassifier(
        labelCol=LABEL, featuresCol="features", weightCol="weight", seed=SEED, **overrides
    )


def fit(train: DataFrame, features: Sequence[str], estimator=None) -> RiskModel:
    """Classifier on class-balanced rows."""
    use_checkpoints(train.sparkSession)
    packed = VectorAssembler(inputCols=list(features), outputCol="features").transform(E.class_weights(train, LABEL))
    chosen = estimator if estimator is not None else boosted_trees()
    return RiskModel(chosen.fit(packed.select("features", LABEL, "weight")), list(features))


def calibrate(model: RiskModel, rows: DataFrame) -> RiskModel:
    """Isotonic curve from raw score to observed failure share.

    Rows of one score are one weighted point, so the curve is fitted to the distinct scores; Spark's fit brings the pooled
    blocks of it to the driver. Too few rows or a single class leave the model uncalibrated.
    """
    counts = rows.agg(F.count("*").alias("n"), F.countDistinct(LABEL).alias("classes")).first()
    if counts["n"] < CALIBRATION_ROWS or counts["classes"] < 2:
        return model
    points = (
        model.raw(rows)
        .groupBy("raw_score")
        .agg(F.avg(LABEL).alias("share"), F.count("*").cast("double").alias("weight"))
    )
    curve = IsotonicRegression(featuresCol="raw_score", labelCol="share", weightCol="weight").fit(points)
    return RiskModel(model.classifier, model.features, curve)


def with_position(dataset: DataFrame, order: Sequence[str] = KEYS) -> DataFrame:
    """Rows with their share of the way through the time order, in (0, 1]."""
    ranked = running_totals(dataset.select(*order).withColumn("_one", F.lit(1).cast("long")), order, ["_one"])
    size = dataset.agg(F.count("*")).scalar()
    places = ranked.withColumn("_n", size).select(*order, (F.col("cum__one") / F.col("_n")).alias("position"))
    return dataset.join(places, list(order))


def fit_calibrated(train: DataFrame, features: Sequence[str], estimator=None, hold_out: bool = True) -> RiskModel:
    """Classifier calibrated on the last fifth of the rows.

    ``hold_out=False`` also trains on that fifth, as the published pipeline does; by default it is kept apart.
    """
    placed = with_position(train)
    tail = F.col("position") > 1 - CALIBRATION_SHARE
    body = placed.filter(~tail) if hold_out else placed
    return calibrate(fit(body, features, estimator), placed.filter(tail))


def _fold_models(folded: DataFrame, features: Sequence[str], n_splits: int, estimator, hold_out: bool) -> list[RiskModel]:
    """The calibrated models of all folds, grown side by side.

    A fold trains on all rows before its test rows, so one rank over all rows gives every fold's calibration rows.
    """
    sizes = {r["test_fold"]: r["count"] for r in folded.groupBy("test_fold").count().collect()}
    whole = sum(sizes.values())
    before = [sum(n for test, n in sizes.items() if test < fold) for fold in range(n_splits)]
    placed = cut_lineage(with_position(folded).withColumn("rank", F.round(F.col("position") * whole)))
    trains = [F.col("test_fold") < fold for fold in range(n_splits)]
    tails = [train & (F.col("rank") / F.lit(max(n, 1)) > 1 - CALIBRATION_SHARE) for train, n in zip(trains, before, strict=True)]
    bodies = [train & ~tail if hold_out else train for train, tail in zip(trains, tails, strict=True)]
    rates = placed.agg(*[F.coalesce(F.avg(F.when(body, F.col(LABEL).cast("double"))), F.lit(0.0)).alias(f"p{i}") for i, body in enumerate(bodies)]).first()
    floor = E.RATE_FLOOR
    rates = [max(p, floor) for p in rates]
    weights = [F.when(body, F.when(F.col(LABEL) == 1, 1 / p).otherwise(1 / (1 - p + floor))).otherwise(0.0) for body, p in zip(bodies, rates, strict=True)]
    table = placed.select(F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.col(LABEL).alias("label"), F.array(*weights).alias("weights"))
    models = estimator.fit_side_by_side(table)
    return [calibrate(RiskModel(model, list(features)), placed.filter(tail)) for model, tail in zip(models, tails, strict=True)]


def cross_validate(
    dataset: DataFrame, features: Sequence[str], n_splits: int = 5, estimator=None, hold_out: bool = True
) -> DataFrame:
    """Out-of-fold scores (fold, keys, label, score) of rolling-origin folds; folds tested on one class are skipped."""
    folded = cut_lineage(E.rolling_folds(dataset, n_splits, KEYS))
    classes = {
        r["test_fold"]: r["n"]
        for r in folded.groupBy("test_fold").agg(F.countDistinct(LABEL).alias("n")).collect()
    }
    chosen = estimator if estimator is not None else boosted_trees()
    grown = _fold_models(folded, features, n_splits, chosen, hold_out) if hasattr(chosen, "fit_side_by_side") else None
    parts = []
    for fold in range(n_splits):
        train = folded.filter(F.col("test_fold") < fold)
        if classes.get(fold, 0) < 2 or train.select(LABEL).distinct().count() < 2:
            continue
        model = grown[fold] if grown else fit_calibrated(train.drop("test_fold"), features, chosen, hold_out)
        parts.append(
            model.score(folded.filter(F.col("test_fold") == fold)).select(
                F.lit(fold).alias("fold"), *KEYS, F.col(LABEL).alias("label"), "score"
            )
        )
    if not parts:
        raise ValueError("no fold has both classes")
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    return cut_lineage(scored)


def fold_metrics(scored: DataFrame) -> DataFrame:
    """Long (fold, metric, value) table of out-of-fold scores."""
    areas = E.long_metrics(
        E.ranking_metrics(scored, by=["fold"]).withColumn("test_pos_rate", F.col("positives") / F.col("n")),
        ("roc_auc", "pr_auc", "brier", "test_pos_rate"),
        ["fold"],
    )
    at_k = E.precision_at_k(scored, by=["fold"], tie="node_id")
    precision = at_k.select(
        "fold", F.format_string("precision_at_%d", "k").alias("metric"), F.col("precision").alias("value")
    )
    lift = at_k.select("fold", F.format_string("lift_at_%d", "k").alias("metric"), F.col("lift").alias("value"))
    return areas.unionByName(precision).unionByName(lift)


def compare_models(dataset: DataFrame, features: Sequence[str], estimators: dict, n_splits: int = 3) -> DataFrame:
    """Headline metrics per model on identical folds, best mean ROC AUC first."""
    tables = [
        E.fold_summary(fold_metrics(cross_validate(dataset, features, n_splits, estimator)))
        .select(F.lit(name).alias("model"), "metric", "mean", "std")
        for name, estimator in estimators.items()
    ]
    stacked = tables[0]
    for table in tables[1:]:
        stacked = stacked.unionByName(table)

    def pick(metric: str, stat: str):
        return F.max(F.when(F.col("metric") == metric, F.col(stat))).alias(f"{metric}_{stat}")

    return (
        stacked.groupBy("model")
        .agg(
            pick("roc_auc", "mean"), pick("roc_auc", "std"), pick("pr_auc", "mean"), pick("brier", "mean"),
            pick("precision_at_10", "mean"), pick("lift_at_10", "mean"),
        )
        .withColumn("winner", F.col("roc_auc_mean") == F.max("roc_auc_mean").over(W.partitionBy()))
        .orderBy(F.desc("roc_auc_mean"), "model")
    )


def top_at_risk(model: RiskModel, window: DataFrame, n: int = 10) -> DataFrame:
    """Riskiest nodes of a scored window."""
    scored = model.score(window, "failure_risk_24h")
    return scored.select("node_id", "rack_id", "zone_id", "failure_risk_24h").orderBy(
        F.desc("failure_risk_24h"), "node_id"
    ).limit(n)


def permutation_importance(
    model: RiskModel, test: DataFrame, repeats: int = 3, seed: int = 42, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Drop in accuracy and in ROC AUC when one feature is shuffled, averaged over the repeats.

    Rows are dealt by hash into random blocks of about a thousand, which is the only exchange of feature values; a
    shuffle rotates the feature inside its block by a random distance. All shuffles are scored in one batch. Of few blocks,
    copies share out the shuffles, so that all tasks have some to score.
    """
    blocks = max(1, test.count() // SHUFFLE_BLOCK)
    partitions = int(test.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = min(max(1, 2 * partitions // blocks), len(model.features) * repeats + 1)
    deal = F.xxhash64(F.lit(seed), *keys)
    dealt = test.select(
        F.pmod(deal, F.lit(blocks)).alias("block"),
        F.struct(
            deal.alias("h"), *keys, F.col(LABEL).alias("label"),
            F.array(*[F.col(c).cast("double") for c in model.features]).alias("x"),
        ).alias("row"),
    )
    shuffles = [F.struct(F.lit(-1).alias("f"), F.lit(0).alias("r"))] + [
        F.struct(F.lit(f).alias("f"), F.lit(r).alias("r")) for f in range(len(model.features)) for r in range(repeats)
    ]
    shift = F.pmod(F.xxhash64(F.lit(seed + 1), "block", "s.f", "s.r"), F.greatest(F.size("rows") - 1, F.lit(1))) + 1

    def rotated(row: Column, place: Column) -> Column:
        donor = F.get("rows", F.pmod(place + F.col("shift"), F.size("rows")))["x"]
        x = F.transform(row["x"], lambda v, i: F.when(i == F.col("s.f"), F.get(donor, i)).otherwise(v))
        return F.struct(row["label"].alias("label"), x.alias("x"))

    swapped = (
        dealt.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        .repartition(partitions, "block", "copy")
        .groupBy("block", "copy")
        .agg(F.array_sort(F.collect_list("row")).alias("rows"))
        .withColumn("s", F.explode(F.get(F.array(*[F.array(*shuffles[own::copies]) for own in range(copies)]), F.col("copy"))))
        .withColumn("shift", shift.cast("int"))
        .select(F.col("s.f").alias("f"), F.col("s.r").alias("r"), F.inline(F.transform("rows", rotated)))
        .withColumn("features", array_to_vector("x"))
    )
    scored = cut_lineage(model.raw_of_vector(swapped, "score").select("f", "r", "label", "score"))
    hits = scored.groupBy("f", "r").agg(
        F.avg(((F.col("score") >= 0.5).cast("int") == F.col("label")).cast("double")).alias("accuracy")
    )
    quality = cut_lineage(E.ranking_metrics(scored, by=["f", "r"]).select("f", "r", "roc_auc").join(hits, ["f", "r"]))
    base = quality.filter("f < 0").select(F.struct("accuracy", "roc_auc")).scalar()
    names = F.array(*map(F.lit, model.features))
    return (
        quality.filter("f >= 0")
        .withColumn("_base", base)
        .groupBy(F.get(names, F.col("f")).alias("feature"))
        .agg(
            F.avg(F.col("_base.accuracy") - F.col("accuracy")).alias("importance"),
            F.avg(F.col("_base.roc_auc") - F.col("roc_auc")).alias("auc_drop"),
        )
        .orderBy(F.desc("importance"), "feature")
    )


def _tree_contributions(model: RiskModel, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((model.classifier, model.classifier.paths()))

    @F.pandas_udf("array<double>")
    def shares(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trees, paths = shared.value
        for part in values:
            x = np.array(part.tolist(), float).reshape(len(part), len(trees.edges))
            yield pd.Series(list(trees.attribution(x, paths)))

    names = F.array(*map(F.lit, model.features))
    packed = rows.select(*keys, F.array(*[F.col(c).cast("double") for c in model.features]).alias("x"))
    each = F.arrays_zip(names.alias("feature"), F.col("x").alias("value"), F.col("shares").alias("contribution"))
    return packed.withColumn("shares", shares("x")).select(*keys, F.inline(each))


def contributions(model: RiskModel, rows: DataFrame, background: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per row and feature its contribution to the score.

    Boosted trees give Shapley values of the log odds from their paths; with the trees' mean they add up to the margin. Of
    other models it is how much the score falls when the feature is reset to its background mean. Rows are scored where
    they are, without an exchange.
    """
    if isinstance(model.classifier, BoostedTrees):
        return _tree_contributions(model, rows, keys)
    means = background.agg(F.array(*[F.avg(F.col(c).cast("double")) for c in model.features]).alias("m")).scalar()
    names = F.array(*map(F.lit, model.features))
    packed = rows.select(*keys, F.array(*[F.col(c).cast("double") for c in model.features]).alias("x"))
    whole = model.raw_of_vector(packed.withColumn("features", array_to_vector("x")), "whole").drop("features")
    reset = (
        whole.withColumn("m", means)
        .withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(len(model.features) - 1))))
        .withColumn(
            "features",
            array_to_vector(F.transform("x", lambda v, i: F.when(i == F.col("f"), F.get("m", i)).otherwise(v))),
        )
    )
    return model.raw_of_vector(reset, "score").select(
        *keys,
        F.get(names, F.col("f")).alias("feature"),
        F.get("x", F.col("f")).alias("value"),
        (F.col("whole") - F.col("score")).alias("contribution"),
    )


def explain_rows(model: RiskModel, rows: DataFrame, background: DataFrame, top_n: int = 6, keys=KEYS) -> DataFrame:
    """Strongest features per row."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(F.abs("contribution")), "feature"))
    return contributions(model, rows, background, keys).withColumn("place", place).filter(F.col("place") <= top_n)


def global_attribution(model: RiskModel, dataset: DataFrame, n_sample: int | None = None, seed: int = 42, keys=KEYS) -> DataFrame:
    """Mean absolute contribution per feature over all rows, or over a uniform sample of ``n_sample`` of them."""
    sample = dataset if n_sample is None else dataset.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n_sample)
    return (
        contributions(model, sample, dataset, keys)
        .groupBy("feature")
        .agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))
        .orderBy(F.desc("mean_abs_contribution"), "feature")
    )
