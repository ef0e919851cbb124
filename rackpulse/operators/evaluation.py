"""Splits, folds and classifier metrics on a table of labels and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rackpulse.functions.ordered import running_totals
from rackpulse.session import cut_lineage

TOP_K = (10, 25, 50)
RATE_FLOOR = 1e-6


def split_cutoff(dataset: DataFrame, test_fraction: float = 0.3, tick: str = "window_end_tick") -> Column:
    """Interpolated quantile of the window ends. Their distinct values are few, which is all the aggregate holds."""
    return dataset.agg(F.percentile(tick, F.lit(1 - test_fraction)).alias("cutoff")).scalar()


def time_based_split(
    dataset: DataFrame, test_fraction: float = 0.3, tick: str = "window_end_tick"
) -> tuple[DataFrame, DataFrame]:
    marked = dataset.withColumn("_cutoff", split_cutoff(dataset, test_fraction, tick))
    train = marked.filter(F.col(tick) <= F.col("_cutoff")).drop("_cutoff")
    return train, marked.filter(F.col(tick) > F.col("_cutoff")).drop("_cutoff")


def rolling_folds(dataset: DataFrame, n_splits: int = 5, order: Sequence[str] = ("window_end_tick", "node_id")) -> DataFrame:
    """Add ``test_fold``: the rolling-origin fold a row is tested in, -1 for rows that only train.

    Fold ``i`` trains on all rows with a smaller ``test_fold``. Rows are ranked globally by ``order``, which must be
    unique.
    """
    ranked = running_totals(dataset.select(*order).withColumn("_one", F.lit(1).cast("long")), order, ["_one"])
    size = dataset.agg(F.count("*")).scalar()
    folds = (
        ranked.withColumn("_n", size)
        .withColumn("_test", F.expr(f"_n div {n_splits + 1}"))
        .withColumn("_from_start", F.col("cum__one") - 1 - (F.col("_n") - F.col("_test") * n_splits))
        .select(
            *order,
            F.when(F.col("_from_start") >= 0, F.expr("_from_start div greatest(_test, 1)")).otherwise(F.lit(-1))
            .cast("int").alias("test_fold"),
        )
    )
    return dataset.join(folds, list(order))


def class_weights(dataset: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    """Inverse-frequency weights: 1 / p for positives, 1 / (1 - p + 1e-6) for the rest."""
    rate = dataset.agg(F.greatest(F.avg(F.col(label).cast("double")), F.lit(RATE_FLOOR)).alias("p")).scalar()
    inverse = F.when(F.col(label) == 1, 1 / F.col("_p")).otherwise(1 / (1 - F.col("_p") + RATE_FLOOR))
    return dataset.withColumn("_p", rate).withColumn(weight, inverse).drop("_p")


def threshold_table(scored: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """Per distinct score, from the highest: its positives and negatives and their running totals."""
    cells = scored.groupBy(*by, (-F.col(score).cast("double")).alias("descending")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    return running_totals(cells, ["descending"], ["pos", "neg"], by).withColumn("threshold", -F.col("descending"))


def ranking_metrics(
    scored: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score"
) -> DataFrame:
    """ROC AUC (ties count half), average precision, Brier score and the threshold with the best F1.

    AUC and average precision are null when only one class is present.
    """
    curve = threshold_table(scored, by, label, score)
    totals = scored.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(label) == 1).alias("positives"),
        F.avg(F.pow(F.col(score) - F.col(label), F.lit(2.0))).alias("brier"),
    )
    sums = totals.select(*by, "n", "positives")
    if by:
        curve = curve.join(sums, list(by))
    else:
        curve = curve.withColumn("_t", sums.select(F.struct("n", "positives")).scalar()).select("*", "_t.*")
    negatives = F.col("n") - F.col("positives")
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    recall = F.try_divide(F.col("cum_pos"), F.col("positives"))
    f1 = 2 * precision * recall / (precision + recall + 1e-12)
    below = negatives - F.col("cum_neg") + F.col("neg") * 0.5
    point = F.struct(
        F.round(f1, 12).alias("f1"), F.col("descending"), precision.alias("precision"), recall.alias("recall")
    )
    areas = curve.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("pos") * below), F.max(F.col("positives") * negatives).cast("double")).alias("roc_auc"),
        F.sum(F.try_divide(F.col("pos") * precision, F.col("positives"))).alias("pr_auc"),
        F.max(point).alias("best"),
    )
    if by:
        joined = totals.join(areas, list(by))
    else:
        joined = totals.withColumn("_a", areas.select(F.struct("roc_auc", "pr_auc", "best")).scalar()).select("*", "_a.*")
    both = (F.col("positives") > 0) & (F.col("positives") < F.col("n"))
    return joined.select(
        *by,
        "n",
        "positives",
        F.when(both, F.col("roc_auc")).alias("roc_auc"),
        F.when(both, F.col("pr_auc")).alias("pr_auc"),
        "brier",
        (-F.col("best.descending")).alias("best_threshold"),
        F.col("best.precision").alias("precision_at_best_f1"),
        F.col("best.recall").alias("recall_at_best_f1"),
        F.col("best.f1").alias("f1_at_best_f1"),
    )


def precision_at_k(
    scored: DataFrame,
    ks: Sequence[int] = TOP_K,
    by: Sequence[str] = (),
    label: str = "label",
    score: str = "score",
    tie: str = "id",
) -> DataFrame:
    """Precision and lift among the K highest scores, one row per K that the table can fill.

    The rank filter is pushed below the shuffle as a per-task limit, so only K rows per task and group move.
    """
    ranked = scored.select(*by, label, score, tie).withColumn(
        "_rank", F.row_number().over(W.partitionBy(*by or [F.lit(0)]).orderBy(F.desc(score), tie))
    )
    top = ranked.filter(F.col("_rank") <= max(ks)).groupBy(*by).agg(
        *[F.avg(F.when(F.col("_rank") <= k, F.col(label).cast("double"))).alias(f"_p_{k}") for k in ks]
    )
    totals = scored.groupBy(*by).agg(F.count("*").alias("_n"), F.avg(F.col(label).cast("double")).alias("_rate"))
    if by:
        joined = top.join(totals, list(by))
    else:
        joined = top.withColumn("_t", totals.select(F.struct("_n", "_rate")).scalar()).select("*", "_t.*")
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_p_{k}").alias("precision")) for k in ks])
    return joined.select(*by, "_n", "_rate", F.inline(rows)).filter("k <= _n").select(
        *by, "k", "precision", (F.col("precision") / F.greatest("_rate", F.lit(RATE_FLOOR))).alias("lift")
    )


def fold_summary(metrics: DataFrame) -> DataFrame:
    """Mean and population deviation of a long (fold, metric, value) table; missing values are skipped."""
    return (
        metrics.filter(F.col("value").isNotNull())
        .groupBy("metric")
        .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("folds"))
    )


def long_metrics(wide: DataFrame, names: Sequence[str], by: Sequence[str]) -> DataFrame:
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names]
    return wide.select(*by, F.inline(F.array(*rows)))


def score_by_label(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """AUC of the score against the label and its mean for each class."""
    auc = ranking_metrics(scored, label=label, score=score).select("roc_auc").scalar()
    return scored.agg(
        F.avg(F.when(F.col(label) == 1, F.col(score))).alias("score_mean_positive"),
        F.avg(F.when(F.col(label) == 0, F.col(score))).alias("score_mean_negative"),
    ).withColumn("score_auc_vs_label", auc)


def concordance(df: DataFrame, duration: str = "duration", event: str = "event", risk: str = "risk") -> DataFrame:
    """Harrell's concordance index: share of comparable pairs in which the earlier failure has the higher risk.

    A failure is compared with every row that outlives it, rows censored at the same time included; equal risks count
    half. Instead of forming pairs, "all later rows" is written as at most log2 blocks of a binary tree over time, and
    inside each block the rows with lower risk are counted by running totals.
    """
    rows = cut_lineage(
        df.groupBy(
            F.col(duration).cast("double").alias("t"),
            (F.col(event) == 1).alias("failed"),
            F.col(risk).cast("double").alias("risk"),
        ).agg(F.count("*").alias("n"))
    )
    times = rows.groupBy("t").agg(F.lit(1).cast("long").alias("_one"))
    places = running_totals(times, ["t"], ["_one"]).select("t", F.col("cum__one").alias("place"))
    cells = cut_lineage(
        rows.join(places, "t").select(
            "risk", "n", "failed", (F.col("place") * 2 + F.when(F.col("failed"), 0).otherwise(1)).alias("u")
        )
    )
    top = cells.agg(F.max("u")).first()[0] or 0
    levels = F.explode(F.sequence(F.lit(0), F.lit(max(int(top).bit_length(), 1))))
    spread = cells.withColumn("level", levels).withColumn("block", F.expr("shiftright(u, level)"))
    zero = F.lit(0).cast("long")
    members = spread.select("level", "block", "risk", F.col("n").alias("later"), zero.alias("asking"))
    queries = spread.filter("failed and block % 2 = 0").select(
        "level", (F.col("block") + 1).alias("block"), "risk", zero.alias("later"), F.col("n").alias("asking")
    )
    merged = members.unionByName(queries).groupBy("level", "block", "risk").agg(
        F.sum("later").alias("later"), F.sum("asking").alias("asking")
    )
    counted = running_totals(merged, ["risk"], ["later"], by=["level", "block"])
    lower = F.col("cum_later") - F.col("later")
    per_block = counted.groupBy("level", "block").agg(
        F.sum("later").alias("later"),
        F.sum("asking").alias("asking"),
        F.sum(F.col("asking") * (lower + F.col("later") * 0.5)).alias("concordant"),
    )
    return per_block.agg(
        F.sum("concordant").alias("concordant"),
        F.sum(F.col("later") * F.col("asking")).alias("comparable_pairs"),
    ).select(
        F.try_divide(F.col("concordant"), F.col("comparable_pairs").cast("double")).alias("concordance"),
        "comparable_pairs",
    )
