"""Queries of the risk, anomaly and survival models.

Model fits have no SQL counterpart; the derived closed forms (hazard curve on given coefficients) do.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.functions.ordered import exact_quantiles
from rackpulse.operators import anomaly, risk, survival
from rackpulse.operators.evaluation import rolling_folds, time_based_split
from rackpulse.operators.window_features import LABEL, V1_FEATURES, with_known_labels
from rackpulse.operators.topology import node_name
from rackpulse.plans import adapters as A
from rackpulse.plans.correlation import enriched_of
from rackpulse.plans.ctes import ENRICHED, METRICS, sql
from rackpulse.plans.evaluation import survival_rows
from rackpulse.plans.features import _AHEAD, _BACK, _BOTH_TOP, _V1, HOPS, _ends, dataset_v1, dataset_v2
from rackpulse.plans.kpi import rounded
from rackpulse.session import materialise, work_path
from rackpulse.sources import node_table, registry, tables

FEATURES = list(V1_FEATURES)
COX_FEATURES = ["risk", "l_discount", "l_tax"]


def windows_v1(spark: SparkSession, sf: str) -> Callable[[], DataFrame]:
    """All nodes of every window, written at the first call, for a query that learns from some windows and scores another."""
    return cache(lambda: materialise(dataset_v1(spark, sf), "windows"))


def stored_v1(spark: SparkSession, sf: str, windows: Callable[[], DataFrame] | None = None) -> DataFrame:
    """Training rows, written once: all nodes of every window that the events still reach."""
    rows = windows() if windows else dataset_v1(spark, sf)
    return materialise(with_known_labels(rows, enriched_of(spark, sf), HOPS), "v1")


def model_split_balance(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and failures in both parts of the time split that the models use."""
    train, test = time_based_split(stored_v1(spark, sf))
    parts = [p.agg(F.count("*").alias("windows"), F.sum(LABEL).alias("failures")).withColumn("part", F.lit(n)) for n, p in (("train", train), ("test", test))]
    return parts[0].unionByName(parts[1])


def _model(dataset: DataFrame) -> risk.RiskModel:
    train, _ = time_based_split(dataset)
    return risk.fit_calibrated(train, FEATURES, risk.boosted_trees())


def risk_gbt(spark: SparkSession, sf: str) -> DataFrame:
    train, test = time_based_split(stored_v1(spark, sf))
    return risk.fit(train, FEATURES, risk.boosted_trees()).raw(test).select("node_id", "window_end_tick", LABEL, "raw_score")


def risk_calibrated(spark: SparkSession, sf: str) -> DataFrame:
    scored = risk.cross_validate(stored_v1(spark, sf), FEATURES, estimator=risk.boosted_trees())
    return risk.E.fold_summary(risk.fold_metrics(scored))


def newest_window(spark: SparkSession, sf: str, windows: Callable[[], DataFrame] | None = None) -> DataFrame:
    """Features of the newest window, whose outcome is not known yet: the one to score."""
    rows = windows() if windows else dataset_v1(spark, sf)
    return materialise(tables.latest_window(rows).drop(LABEL), "newest")


def scored_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Per window its rows, and whether models learn from it; the last one is the window that gets scored."""
    rows = dataset_v1(spark, sf).select("window_end_tick", "node_id")
    known = with_known_labels(rows, enriched_of(spark, sf), HOPS).groupBy("window_end_tick").agg(F.count("*").alias("labelled"))
    every = rows.groupBy("window_end_tick").agg(F.count("*").alias("windows"))
    return every.join(known, "window_end_tick", "left").select("window_end_tick", "windows", F.coalesce("labelled", F.lit(0)).alias("labelled"))


def top_at_risk(spark: SparkSession, sf: str) -> DataFrame:
    return risk.top_at_risk(_model(stored_v1(spark, sf)), newest_window(spark, sf))


def risk_attribution(spark: SparkSession, sf: str) -> DataFrame:
    windows = windows_v1(spark, sf)
    dataset = stored_v1(spark, sf, windows)
    return risk.explain_rows(_model(dataset), newest_window(spark, sf, windows), dataset)


def global_attribution(spark: SparkSession, sf: str) -> DataFrame:
    dataset = stored_v1(spark, sf)
    return risk.global_attribution(_model(dataset), dataset)


def permutation_importance(spark: SparkSession, sf: str) -> DataFrame:
    dataset = stored_v1(spark, sf)
    return risk.permutation_importance(_model(dataset), time_based_split(dataset)[1])


def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    estimators = {"boosted_trees": risk.boosted_trees(), "logistic": risk.logistic()}
    return risk.compare_models(stored_v1(spark, sf), FEATURES, estimators)


def batch_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """Failure risk and anomaly score per node of the newest window."""
    windows = windows_v1(spark, sf)
    dataset = stored_v1(spark, sf, windows)
    latest = newest_window(spark, sf, windows)
    failure = _model(dataset).score(latest, "failure_risk_24h").select("node_id", "failure_risk_24h")
    detector = anomaly.train_anomaly_detector(dataset, FEATURES)
    odd = anomaly.anomaly_scores(detector, latest.select("node_id", *FEATURES)).select("node_id", "anomaly_score")
    return failure.join(odd, "node_id")


def anomaly_scores(spark: SparkSession, sf: str) -> DataFrame:
    dataset = materialise(dataset_v2(spark, sf), "v2")
    features = [c for c in dataset.columns if "__" in c or c.startswith("ev_")]
    detector = anomaly.train_anomaly_detector(dataset, features)
    return anomaly.anomaly_scores(detector, dataset.select("node_id", "window_end_tick", *features)).select(
        "node_id", "window_end_tick", "anomaly_score"
    )


def anomaly_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    dataset = stored_v1(spark, sf)
    return anomaly.evaluate_anomaly(anomaly.train_anomaly_detector(dataset, FEATURES), dataset)


def score_normalisation(spark: SparkSession, sf: str) -> DataFrame:
    """A raw score (windowed event pressure) scaled between its fifth and ninety-fifth percentile, clipped."""
    scores = dataset_v1(spark, sf).select("node_id", "window_end_tick", F.col("zone_events_in_window").alias("raw"))
    low, high = exact_quantiles(scores, "raw", [anomaly.LOW, anomaly.HIGH]).first()["quantiles"]
    return rounded(anomaly.normalise(scores, low, high).drop("raw"), 6, "anomaly_score")


def _cox(spark: SparkSession, sf: str) -> tuple[survival.CoxModel, DataFrame]:
    rows = materialise(survival_rows(spark, sf), "survival")
    return survival.fit_cox(rows, COX_FEATURES), rows


def cox_hazard(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted coefficients on the original scale, with the remaining gradient."""
    model, _ = _cox(spark, sf)
    rows = [(c, float(b / s), float(m)) for c, b, s, m in zip(model.features, model.beta, model.scale, model.mean, strict=True)]
    fitted = spark.createDataFrame(rows, "feature string, coefficient double, mean double")
    return fitted.withColumn("gradient_norm", F.lit(model.gradient_norm))


def survival_curve(spark: SparkSession, sf: str) -> DataFrame:
    model, rows = _cox(spark, sf)
    return survival.baseline_survival(model, rows)


def hazard_curve_given(spark: SparkSession, sf: str) -> DataFrame:
    """Baseline hazard for stated coefficients, which SQL can follow exactly."""
    given = survival.CoxModel(COX_FEATURES, np.array([0.01, -0.5, 0.25]), np.zeros(3), np.ones(3), 0.0)
    curve = survival.baseline_survival(given, survival_rows(spark, sf))
    return rounded(curve, 9, "cumulative_hazard", "survival")


def survival_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """Events and censored windows per duration, published and observed time."""
    dataset = materialise(dataset_v2(spark, sf), "v2")
    parts = []
    for name, observed in (("constant", False), ("observed", True)):
        rows = survival.survival_dataset(dataset, [], horizon_hours=120, observed_time=observed)
        parts.append(
            rows.groupBy("duration", "event").agg(F.count("*").alias("windows")).withColumn("form", F.lit(name))
        )
    return rounded(parts[0].unionByName(parts[1]), 6, "duration")


def survival_training(spark: SparkSession, sf: str) -> DataFrame:
    model = survival.train_survival(stored_v1(spark, sf), FEATURES)
    return spark.createDataFrame([(k, float(v) if v is not None else None) for k, v in model.metrics.items()],
                                 "metric string, value double")


def registry_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A calibrated model registered twice, the newest version loaded back and used."""
    dataset = stored_v1(spark, sf)
    model = _model(dataset)
    root = work_path(spark, "registry")
    for note in ("first", "second"):
        registry.register_risk_model(spark, root, model, dataset, note=note)
    version, again = registry.load_risk_model(spark, root)
    request = tables.scoring_input(newest_window(spark, sf), again.features, ("node_id",))
    return again.score(again.raw(request).withColumnRenamed("raw_score", "uncalibrated")).select(
        F.lit(version).alias("version"), "node_id", F.col("uncalibrated").alias("raw_score"), "score"
    )


def scoring_input(spark: SparkSession, sf: str) -> DataFrame:
    """Request rows completed to the model's columns: two are missing and one is partly null."""
    rows = dataset_v1(spark, sf).drop("n_psu_trip", "util_std").withColumn(
        "util_mean", F.when(F.col("util_mean") > 0.3, F.col("util_mean"))
    )
    return rounded(tables.scoring_input(rows, FEATURES, ("node_id", "window_end_tick")), 6, *FEATURES)


def latest_window(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshot of the last window, written and read back."""
    path = work_path(spark, "latest")
    tables.write_latest_window(dataset_v1(spark, sf).select("node_id", "window_end_tick", "n_thermal_throttle", LABEL), path)
    return spark.read.parquet(path)


def node_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """For every order, the newest window of the node with the customer's number; many customers have no node."""
    name = f"latest_{uuid.uuid4().hex}"
    node_table.save(tables.latest_window(dataset_v1(spark, sf)), name, work_path(spark, "node-table"))
    requests = A.table(spark, sf, "orders").select("o_orderkey", node_name(F.col("o_custkey")).alias("node_id"))
    columns = ["window_end_tick", "n_thermal_throttle", "util_mean"]
    return rounded(node_table.look_up(spark.table(name), requests, columns), 6, "util_mean")


def fold_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Training and test rows with the class balance of every rolling fold."""
    folded = rolling_folds(dataset_v1(spark, sf).select("window_end_tick", "node_id", LABEL), 3)
    spread = folded.withColumn("fold", F.explode(F.sequence(F.greatest("test_fold", F.lit(0)), F.lit(2))))
    return spread.groupBy("fold").agg(
        F.count_if(F.col("test_fold") < F.col("fold")).alias("n_train"),
        F.count_if(F.col("test_fold") == F.col("fold")).alias("n_test"),
        F.sum(F.when(F.col("test_fold") == F.col("fold"), F.col(LABEL))).alias("test_positives"),
    )


QUERIES = {
    "risk_gbt": risk_gbt,
    "risk_calibrated": risk_calibrated,
    "top_at_risk": top_at_risk,
    "risk_attribution": risk_attribution,
    "global_attribution": global_attribution,
    "model_split_balance": model_split_balance,
    "scored_windows": scored_windows,
    "permutation_importance": permutation_importance,
    "model_comparison": model_comparison,
    "batch_scoring": batch_scoring,
    "anomaly_scores": anomaly_scores,
    "anomaly_evaluation": anomaly_evaluation,
    "score_normalisation": score_normalisation,
    "cox_hazard": cox_hazard,
    "survival_curve": survival_curve,
    "hazard_curve_given": hazard_curve_given,
    "survival_dataset": survival_dataset,
    "survival_training": survival_training,
    "registry_round_trip": registry_round_trip,
    "scoring_input": scoring_input,
    "latest_window": latest_window,
    "node_lookup": node_lookup,
    "fold_sizes": fold_sizes,
}

_FILLED = ", ".join(
    "0.0::double as " + c if c in ("n_psu_trip", "util_std")
    else "case when util_mean > 0.3::double then util_mean else 0 end as util_mean" if c == "util_mean"
    else f"{c}::double as {c}"
    for c in FEATURES
)

ORACLES = {
    "model_split_balance": sql(
        _V1,
        f""", k as (select * from v1 where window_end_tick + {HOPS.horizon} <= (select max(tick) from enriched)),
c as (select quantile_cont(window_end_tick::double, 0.7::double) as cut from k)
select case when window_end_tick <= cut then 'train' else 'test' end as part, count(*) as windows, sum({LABEL}) as failures
from k, c group by 1""",
    ),
    "scored_windows": sql(
        _V1,
        f""" select window_end_tick, count(*) as windows,
  count(*) filter (window_end_tick + {HOPS.horizon} <= (select max(tick) from enriched)) as labelled from v1 group by 1""",
    ),
    "score_normalisation": sql(
        _V1,
        """, q as (select quantile_cont(zone_events_in_window::double, 0.05::double) as lo,
  quantile_cont(zone_events_in_window::double, 0.95::double) as hi from v1)
select node_id, window_end_tick, round(greatest(0, least(1, (zone_events_in_window - lo) / greatest(hi - lo, 1e-9::double))), 6)
  as anomaly_score from v1, q""",
    ),
    "hazard_curve_given": """
with s as (
  select date_diff('day', o_orderdate, l_shipdate)::double as duration,
    exp(0.01::double * l_quantity - 0.5::double * l_discount + 0.25::double * l_tax) as w, (l_returnflag = 'R')::int as ev
  from lineitem join orders on l_orderkey = o_orderkey),
d as (select duration, sum(w) as w, cast(sum(ev) as bigint) as events from s group by duration),
r as (select duration, events, events / sum(w) over (order by duration desc) as h from d),
c as (select duration, events, sum(h) over (order by duration) as ch from r)
select cast(duration as bigint) as duration, events, round(ch, 9) as cumulative_hazard, round(exp(-ch), 9) as survival from c""",
    "survival_dataset": sql(
        f"{METRICS},{ENRICHED},\n{_ends(_BOTH_TOP)}",
        f""", seen as (select distinct node_id, e from metrics join ends on {_BACK}),
hit as (select node_id, e, min(tick) as t from enriched join ends on {_AHEAD} group by 1, 2),
s as (select e, t, (t is not null)::int as event from seen left join hit using (node_id, e))
select 120.0::double as duration, event, count(*) as windows, 'constant' as form from s group by event
union all
select round(case when event = 1 then least((t - e) / 12, 120) else 120 end, 6) as duration, event, count(*), 'observed'
from s group by 1, 2""",
    ),
    "scoring_input": sql(_V1, f"select node_id, window_end_tick, {_FILLED} from v1"),
    "latest_window": sql(
        _V1,
        "select node_id, window_end_tick, n_thermal_throttle, failed_next_24h from v1"
        " where window_end_tick = (select max(window_end_tick) from v1)",
    ),
    "node_lookup": sql(
        _V1,
        """, w as (select * from v1 where window_end_tick = (select max(window_end_tick) from v1))
select o_orderkey, format('node-{:04d}', o_custkey) as node_id, w.node_id is not null as found, window_end_tick,
  n_thermal_throttle, round(util_mean, 6) as util_mean
from orders left join w on w.node_id = format('node-{:04d}', o_custkey)""",
    ),
    "fold_sizes": sql(
        _V1,
        """, r as (select failed_next_24h as y, row_number() over (order by window_end_tick, node_id) - 1 as i, count(*) over () as n from v1),
f as (select *, n - (3 - fold) * (n // 4) as start_row from r, range(3) t(fold))
select cast(fold as int) as fold, count(*) filter (i < start_row) as n_train, count(*) filter (i >= start_row and i < start_row + n // 4) as n_test,
  cast(sum(y) filter (i >= start_row and i < start_row + n // 4) as bigint) as test_positives from f group by fold""",
    ),
}
