from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rackpulse.operators import anomaly, boosting, risk, survival
from rackpulse.operators.boosting import BoostedTrees
from rackpulse.operators.evaluation import ranking_metrics, time_based_split
from rackpulse.operators.window_features import LABEL
from rackpulse.sources import registry, tables

FEATURES = ["signal", "noise", "flat"]
QUICK = {"rounds": 5, "depth": 3, "step": 0.3}


@pytest.fixture(scope="module")
def dataset(spark):
    """40 windows of 15 nodes; a high signal makes a failure likely."""
    rng = np.random.default_rng(11)
    rows = []
    for window in range(40):
        for node in range(15):
            x = float(rng.normal())
            y = int(rng.random() < 1 / (1 + np.exp(-(3 * x - 1))))
            rows.append((window * 72, f"node-{node:04d}", "rack-000", "zone-0", x, float(rng.normal()), 1.0, y))
    schema = f"window_end_tick long, node_id string, rack_id string, zone_id string, signal double, noise double, flat double, {LABEL} int"
    return spark.createDataFrame(rows, schema).cache()


@pytest.fixture(scope="module")
def model(dataset):
    return risk.fit_calibrated(time_based_split(dataset)[0], FEATURES, risk.boosted_trees(**QUICK))


def test_risk_scores_rank_failures(dataset, model):
    scored = model.score(time_based_split(dataset)[1]).withColumn("label", F.col(LABEL))
    assert model.calibration is not None
    assert scored.filter("score < 0 or score > 1").count() == 0
    assert ranking_metrics(scored).first().roc_auc > 0.75


def test_leaderboard_is_descending(dataset, model):
    board = risk.top_at_risk(model, tables.latest_window(dataset), 10).collect()
    scores = [r.failure_risk_24h for r in board]
    assert len(board) == 10 and scores == sorted(scores, reverse=True)


def test_cross_validation_and_summary(dataset):
    scored = risk.cross_validate(dataset, FEATURES, 3, risk.boosted_trees(**QUICK))
    assert scored.count() == 3 * (600 // 4)
    summary = {r.metric: r for r in risk.E.fold_summary(risk.fold_metrics(scored)).collect()}
    assert summary["roc_auc"].folds == 3 and summary["roc_auc"]["mean"] > 0.7
    assert {"pr_auc", "brier", "precision_at_10", "lift_at_50"} <= summary.keys()


def test_calibration_needs_both_classes(dataset, model):
    plain = risk.RiskModel(model.classifier, FEATURES)
    assert risk.calibrate(plain, dataset.filter(f"{LABEL} = 0")) is plain
    assert risk.calibrate(plain, dataset.limit(5)) is plain


def test_importance_and_attribution_find_the_signal(dataset, model):
    importance = risk.permutation_importance(model, time_based_split(dataset)[1], repeats=2).collect()
    assert importance[0].feature == "signal" and importance[0].importance > 0.05
    assert next(r for r in importance if r.feature == "flat").auc_drop == pytest.approx(0)
    top = risk.explain_rows(model, tables.latest_window(dataset), dataset, top_n=2).collect()
    # Shapley values: where the signal is near its mean, something else may come first.
    assert len(top) == 30 and sum(r.feature == "signal" for r in top if r.place == 1) >= 12
    overall = risk.global_attribution(model, dataset, 100).collect()
    assert overall[0].feature == "signal" and overall[-1].mean_abs_contribution == 0


def test_shuffles_of_one_block_are_scored_by_several_tasks(spark, dataset, model, monkeypatch):
    test = time_based_split(dataset)[1].cache()
    tasks, scored = [], risk.RiskModel.raw_of_vector

    def spy(self, df, column="raw_score"):
        tasks.append(df.select(F.spark_partition_id().alias("p")).distinct().count())
        return scored(self, df, column)

    monkeypatch.setattr(risk.RiskModel, "raw_of_vector", spy)
    found, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("1", "4"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            found.append({r.feature: (r.importance, r.auc_drop) for r in risk.permutation_importance(model, test).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    test.unpersist()
    assert tasks[0] == 1 and tasks[1] > 1
    assert set(found[0]) == set(FEATURES) and all(found[0][f] == pytest.approx(found[1][f], abs=1e-12) for f in FEATURES)


def test_comparison_names_one_winner(dataset):
    estimators = {"trees": risk.boosted_trees(**QUICK), "linear": risk.logistic(maxIter=10)}
    rows = risk.compare_models(dataset, FEATURES, estimators, 2).collect()
    assert {r.model for r in rows} == set(estimators) and [r.winner for r in rows] == [True, False]


def test_registry(spark, dataset, model, tmp_path):
    root = str(tmp_path / "registry")
    assert registry.load_latest(spark, root, {}) is None
    edges = spark.createDataFrame([("signal", 0.0)], "feature string, q0 double")
    for note in ("one", "two"):
        registry.register(spark, root, {"classifier": model.classifier}, dataset, FEATURES, {"edges": edges}, note=note)
    loaded = registry.load_latest(spark, root, {"classifier": BoostedTrees})
    assert (loaded["version"], loaded["metadata"]["note"], loaded["tables"]["edges"].count()) == (2, "two", 1)
    again = risk.RiskModel(loaded["models"]["classifier"], loaded["metadata"]["feature_names"])
    rows = tables.latest_window(dataset)
    before = {r.node_id: r.raw_score for r in model.raw(rows).collect()}
    assert {r.node_id: r.raw_score for r in again.raw(rows).collect()} == before


def test_anomalies_stand_out(spark):
    rng = np.random.default_rng(12)
    rows = [(w, f"n{i}", *map(float, rng.normal(size=2)), 0) for w in range(20) for i in range(40)]
    rows += [(w, "odd", 9.0, -9.0, 1) for w in range(20)]
    df = spark.createDataFrame(rows, f"window_end_tick long, node_id string, a double, b double, {LABEL} int")
    detector = anomaly.train_anomaly_detector(df, ["a", "b"], trees=40)
    assert detector.trees.select("tree").distinct().count() == 40
    assert detector.trees.filter("feature < 0").groupBy("tree").agg(F.sum("size").alias("s")).filter("s > 256").count() == 0
    scored = anomaly.anomaly_scores(detector, df).cache()
    assert scored.filter("anomaly_score < 0 or anomaly_score > 1").count() == 0
    result = anomaly.evaluate_anomaly(detector, df).first()
    # Scores are clipped at the 95th training percentile: about 5 % of the healthy rows tie with the anomalies.
    assert result.score_auc_vs_label > 0.96 and result.score_mean_positive > 0.9
    one = df.filter("node_id = 'odd'").limit(1)
    assert anomaly.anomaly_scores(detector, one).first().anomaly_score > 0.9
    assert anomaly.anomaly_scores(detector, one, batch_range=True).first().anomaly_score == 0.0


def test_expected_path_lengths():
    assert anomaly.expected_path([0, 1, 2]).tolist() == [0.0, 0.0, 1.0]
    assert float(anomaly.expected_path(256)) == pytest.approx(10.244, abs=1e-3)


def test_subsamples_are_alike_at_every_length(spark):
    for n in (2_000, 60_000):
        rows = spark.range(n).select(F.col("id").alias("k"), F.array(F.col("id").cast("double")).alias("x"))
        sizes = [r["count"] for r in anomaly.subsamples(rows, ["k"], 50, 1).groupBy("tree").count().collect()]
        # One and a half times the subsample of 256 on average, for short and for long tables.
        assert len(sizes) == 50 and 256 < min(sizes) and max(sizes) < 512


def partial_likelihood_gradient(x, duration, event, beta, penalty):
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    w = np.exp(x @ beta)
    gradient = np.zeros(x.shape[1])
    for i in np.flatnonzero(event):
        risk_set = duration >= duration[i]
        gradient += x[i] - (w[risk_set, None] * x[risk_set]).sum(axis=0) / w[risk_set].sum()
    return gradient / len(x) - penalty * beta


@pytest.mark.parametrize("extra", [0, 12])
def test_cox_fit_is_stationary(spark, extra):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(400, 2 + extra))
    duration = np.minimum(np.ceil(rng.exponential(np.exp(-(x[:, 0] - 0.5 * x[:, 1])) * 8)), 24)
    event = (duration < 24).astype(int)
    names = [f"f{i}" for i in range(x.shape[1])]
    rows = [(*map(float, a), float(d), int(e)) for a, d, e in zip(x, duration, event, strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", duration double, event int")
    model = survival.fit_cox(df, names, penalty=0.1)
    gradient = partial_likelihood_gradient(x, duration, event, model.beta, 0.1)
    assert np.abs(gradient).max() < 1e-6 and model.gradient_norm < 1e-6
    assert model.beta[0] > 0.2 > 0 > model.beta[1]
    if not extra:
        curve = survival.baseline_survival(model, df).orderBy("duration").collect()
        values = [r.survival for r in curve]
        assert values == sorted(values, reverse=True) and 0 < values[-1] < 1
        at = survival.survival_at(model, df, survival.baseline_survival(model, df), [0.0, 5.0, 24.0]).first().survival
        assert at[0] == 1.0 and at[0] >= at[1] >= at[2]


def test_survival_training(dataset):
    model = survival.train_survival(dataset, FEATURES)
    assert model.features == ["signal", "noise"]
    assert model.metrics["c_index"] > 0.7 and model.metrics["n_train"] + model.metrics["n_test"] == 600


def test_observed_durations(spark):
    rows = [(0, "a", 1, 24), (0, "b", 0, None)]
    df = spark.createDataFrame(rows, f"window_end_tick long, node_id string, {LABEL} int, first_event_tick long")
    published = survival.survival_dataset(df, []).collect()
    observed = survival.survival_dataset(df, [], observed_time=True).orderBy("node_id").collect()
    assert {r.duration for r in published} == {24.0}
    assert [(r.duration, r.event) for r in observed] == [(2.0, 1), (24.0, 0)]


def test_registered_model_queries_use_the_operators_defaults(monkeypatch):
    from unittest.mock import MagicMock

    from rackpulse.plans import models

    parts = {name: MagicMock(name=name) for name in ("risk", "anomaly", "survival", "tables", "registry", "stored_v1", "newest_window", "work_path")}
    for name, part in parts.items():
        monkeypatch.setattr(models, name, part)
    monkeypatch.setattr(models, "time_based_split", lambda rows: (rows, rows))
    for query in ("risk_gbt", "risk_calibrated", "permutation_importance", "model_comparison", "batch_scoring", "anomaly_evaluation", "survival_training"):
        getattr(models, query)(MagicMock(), "sf")
    given = parts["risk"]
    assert {(c.args, tuple(c.kwargs)) for c in (*given.boosted_trees.call_args_list, *given.logistic.call_args_list)} == {((), ())}
    assert given.cross_validate.call_args.args[2:] == () and set(given.cross_validate.call_args.kwargs) <= {"estimator"}
    assert not given.permutation_importance.call_args.kwargs and len(given.permutation_importance.call_args.args) == 2
    assert not given.compare_models.call_args.kwargs and len(given.compare_models.call_args.args) == 3
    assert all(not c.kwargs and len(c.args) == 2 for c in parts["anomaly"].train_anomaly_detector.call_args_list)
    assert list(parts["survival"].train_survival.call_args.args[1]) == models.FEATURES


@pytest.mark.parametrize("query, rows", [("risk_attribution", 15 * 3), ("batch_scoring", 15)])
def test_windows_to_learn_from_and_to_score_are_built_once(spark, dataset, monkeypatch, query, rows):
    from rackpulse.plans import models

    built = []
    top = spark.createDataFrame([(30 * 72 + models.HOPS.horizon,)], "tick long")
    monkeypatch.setattr(models, "dataset_v1", lambda *_: built.append(1) or dataset)
    monkeypatch.setattr(models, "enriched_of", lambda *_: top)
    monkeypatch.setattr(models, "FEATURES", FEATURES)
    monkeypatch.setattr(models.risk, "boosted_trees", lambda: boosting.HistogramTrees(**QUICK))
    assert getattr(models, query)(spark, "sf").count() == rows and len(built) == 1
    windows = models.windows_v1(spark, "sf")
    for part in (models.stored_v1, models.newest_window):
        assert sorted(part(spark, "sf", windows).collect()) == sorted(part(spark, "sf").collect())
    assert models.stored_v1(spark, "sf", windows).count() == 31 * 15


def test_trees_draw_different_rows_and_all_of_a_short_table(spark):
    rows = spark.range(100).select(F.col("id").alias("k"), F.array(F.col("id").cast("double")).alias("x"))
    assert {r["count"] for r in anomaly.subsamples(rows, ["k"], 5, 1).groupBy("tree").count().collect()} == {100}
    rows = spark.range(50_000).select(F.col("id").alias("k"), F.array(F.col("id").cast("double")).alias("x"))
    sample = anomaly.subsamples(rows, ["k"], 40, 1)
    taken = sample.toPandas()
    assert list(taken.columns) == ["k", "x", "tree", "pick"] and not taken.duplicated(["tree", "k"]).any()
    assert taken["k"].nunique() > 0.8 * len(taken)
    again = anomaly.subsamples(rows.repartition(7), ["k"], 40, 1).toPandas()
    assert set(zip(again["tree"], again["k"])) == set(zip(taken["tree"], taken["k"]))
    assert anomaly.subsamples(rows.limit(0), ["k"], 5, 1).count() == 0
