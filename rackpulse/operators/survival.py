"""Cox proportional hazards on window data, with every pass over the rows a distributed sum."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rackpulse.functions.scaling import fit_scaler
from rackpulse.operators import evaluation as E
from rackpulse.operators.window_features import LABEL, varying_columns
from rackpulse.schemas import TICKS_PER_HOUR
from rackpulse.session import cut_lineage

# Ridge penalty and the deviation below which a feature is dropped.
PENALTY = 0.1
LEAST_SPREAD = 1e-6
NARROW = 10


@dataclass
class CoxModel:
    features: list[str]
    beta: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    gradient_norm: float
    metrics: dict = field(default_factory=dict)

    def log_hazard(self) -> Column:
        """Linear predictor as a column expression, zero at the training means."""
        terms = [
            (F.col(c).cast("double") - float(m)) * float(b / s)
            for c, m, s, b in zip(self.features, self.mean, self.scale, self.beta, strict=True)
        ]
        total = terms[0]
        for term in terms[1:]:
            total = total + term
        return total

    def partial_hazard(self, df: DataFrame, column: str = "partial_hazard") -> DataFrame:
        return df.withColumn(column, F.exp(self.log_hazard()))


def survival_dataset(
    dataset: DataFrame,
    features: Sequence[str],
    horizon_hours: int = 24,
    ticks_per_hour: int = TICKS_PER_HOUR,
    observed_time: bool = False,
    keep: Sequence[str] = ("window_end_tick", "node_id"),
) -> DataFrame:
    """Features, ``duration`` in hours and ``event``.

    The published duration is the horizon for every row. ``observed_time=True`` uses the time to the first event
    instead, censored at the horizon.
    """
    duration: Column = F.lit(float(horizon_hours))
    if observed_time:
        wait = (F.col("first_event_tick") - F.col("window_end_tick")) / ticks_per_hour
        duration = F.when(F.col(LABEL) == 1, F.least(wait, duration)).otherwise(duration)
    return dataset.select(*keep, *features, duration.alias("duration"), F.col(LABEL).cast("int").alias("event"))


def _layout(p: int) -> list[tuple[str, int, int]]:
    """Entries of the sums in order: w, w x, w x x' (full square), events, event x."""
    return (
        [("w", 0, 0)]
        + [("wx", i, 0) for i in range(p)]
        + [("wxx", i, j) for i in range(p) for j in range(p)]
        + [("e", 0, 0)]
        + [("ex", i, 0) for i in range(p)]
    )


def _risk_sums(rows: DataFrame, beta: np.ndarray) -> np.ndarray:
    """Per distinct duration, longest first: sums over its rows of w, w x, w x x' (w = exp(beta x)), events, event x.

    A few features are summed by plain aggregate columns. Many features would make that aggregate too wide, so each
    batch is reduced by matrix products first. The driver receives (durations x features^2) numbers; durations lie on
    the tick, hour or day grid, so time bounds how many there are.
    """
    sums = _narrow_sums(rows, beta) if len(beta) <= NARROW else _wide_sums(rows, beta)
    return sums.sort_values("duration", ascending=False).drop(columns="duration").to_numpy(dtype=float)


def _narrow_sums(rows: DataFrame, beta: np.ndarray) -> pd.DataFrame:
    p = len(beta)
    x = [F.get("x", F.lit(i)) for i in range(p)]
    score = sum((x[i] * float(beta[i]) for i in range(1, p)), x[0] * float(beta[0]))
    weighted = rows.select("duration", "event", F.exp(score).alias("w"), *[x[i].alias(f"x{i}") for i in range(p)])
    w, e = F.col("w"), F.col("event")

    def entry(kind: str, i: int, j: int) -> Column:
        return {
            "w": w, "wx": w * F.col(f"x{i}"), "wxx": w * F.col(f"x{i}") * F.col(f"x{j}"), "e": e, "ex": e * F.col(f"x{i}"),
        }[kind]

    names = [f"{kind}_{i}_{j}" for kind, i, j in _layout(p)]
    sums = [F.sum(entry(*part)).alias(name) for part, name in zip(_layout(p), names, strict=True)]
    return weighted.groupBy("duration").agg(*sums).select("duration", *names).toPandas()


def _wide_sums(rows: DataFrame, beta: np.ndarray) -> pd.DataFrame:
    p = len(beta)
    width = len(_layout(p))
    shared = beta.tolist()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = np.array(shared)
        sums: dict[float, np.ndarray] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            x, event = np.stack(pdf["x"].to_numpy()), pdf["event"].to_numpy(dtype=float)
            w = np.exp(x @ b)
            for duration, at in pdf.groupby("duration").indices.items():
                xs, ws, es = x[at], w[at], event[at]
                wx = xs * ws[:, None]
                entry = np.concatenate([[ws.sum()], wx.sum(axis=0), (xs.T @ wx).ravel(), [es.sum()], es @ xs])
                sums[duration] = sums.get(duration, 0.0) + entry
        for duration, entry in sums.items():
            yield pd.DataFrame({"duration": duration, "pos": np.arange(width), "v": entry})

    cells = rows.mapInPandas(partial, "duration double, pos int, v double")
    summed = cells.groupBy("duration", "pos").agg(F.sum("v").alias("v")).toPandas()
    return summed.pivot(index="duration", columns="pos", values="v").reset_index()


def _derivatives(table: np.ndarray, p: int):
    """Breslow log likelihood pieces: gradient and information, risk sets cumulated from the longest duration."""
    at_risk = np.cumsum(table[:, : 1 + p + p * p], axis=0)
    s0, s1 = at_risk[:, 0], at_risk[:, 1 : 1 + p]
    s2 = at_risk[:, 1 + p :].reshape(-1, p, p)
    events, event_x = table[:, 1 + p + p * p], table[:, 2 + p + p * p :]
    mean = s1 / s0[:, None]
    gradient = event_x.sum(axis=0) - (events[:, None] * mean).sum(axis=0)
    spread = s2 / s0[:, None, None] - mean[:, :, None] * mean[:, None, :]
    return gradient, (events[:, None, None] * spread).sum(axis=0)


def fit_cox(
    rows: DataFrame, features: Sequence[str], penalty: float = PENALTY, max_iter: int = 25, tolerance: float = 1e-7
) -> CoxModel:
    """Newton iterations on the ridge-penalised partial likelihood, in standardised feature space.

    The penalty applies per observation, as in the usual formulation ``loglik / n - penalty / 2 * |beta|^2``.
    """
    features = list(features)
    base = rows.select(
        *[F.col(c).cast("double").alias(c) for c in features], F.col("duration").cast("double").alias("duration"),
        F.col("event").cast("int").alias("event"),
    )
    scaler = fit_scaler(base, features).first()
    mean = np.array([scaler["mean"][c] for c in features])
    scale = np.array([scaler["scale"][c] for c in features])
    scaled = base.select(
        F.array(*[(F.col(c) - float(m)) / float(s) for c, m, s in zip(features, mean, scale, strict=True)]).alias("x"),
        "duration", "event",
    )
    packed = cut_lineage(scaled)
    n = packed.count()
    beta = np.zeros(len(features))
    norm = np.inf
    for _ in range(max_iter):
        gradient, information = _derivatives(_risk_sums(packed, beta), len(features))
        gradient = gradient / n - penalty * beta
        norm = float(np.abs(gradient).max())
        if norm < tolerance:
            break
        hessian = information / n + penalty * np.eye(len(features))
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step / max(1.0, float(np.abs(step).max()) / 2.0)
    return CoxModel(features, beta, mean, scale, norm)


def train_survival(
    dataset: DataFrame, features: Sequence[str], horizon_hours: int = 24, test_fraction: float = 0.3, **options
) -> CoxModel:
    """Fit on the training period, without near-constant features; concordance on both periods.

    A fit that fails numerically comes back with the message in its metrics.
    """
    kept = varying_columns(dataset, list(features), LEAST_SPREAD)
    if not kept:
        raise ValueError("all features are constant")
    train, test = E.time_based_split(dataset, test_fraction)
    train, test = (
        cut_lineage(survival_dataset(part, kept, horizon_hours, **options)) for part in (train, test)
    )
    try:
        model = fit_cox(train, kept)
    except np.linalg.LinAlgError as error:
        nothing = np.zeros(len(kept))
        return CoxModel(kept, nothing, nothing, nothing + 1, np.inf, {"error": str(error)[:200]})
    sizes = {
        name: part.agg(F.count("*").alias("n"), F.avg("event").alias("rate")).first()
        for name, part in (("train", train), ("test", test))
    }
    model.metrics = {
        "concordance_train": _c_index(model, train),
        "c_index": _c_index(model, test),
        "n_train": sizes["train"]["n"],
        "n_test": sizes["test"]["n"],
        "event_rate_train": sizes["train"]["rate"],
        "event_rate_test": sizes["test"]["rate"],
    }
    return model


def _c_index(model: CoxModel, rows: DataFrame) -> float | None:
    return E.concordance(model.partial_hazard(rows, "risk")).first()["concordance"]


def baseline_survival(model: CoxModel, rows: DataFrame) -> DataFrame:
    """Breslow baseline: per distinct duration the cumulative hazard and survival at the training means.

    Windows run over the table of distinct durations, not over the rows.
    """
    weighted = model.partial_hazard(rows, "_w")
    per_duration = weighted.groupBy("duration").agg(F.sum("_w").alias("w"), F.sum("event").alias("events"))
    later = W.orderBy(F.desc("duration")).rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.orderBy("duration").rowsBetween(W.unboundedPreceding, W.currentRow)
    hazard = per_duration.withColumn("at_risk", F.sum("w").over(later)).withColumn(
        "hazard", F.col("events") / F.col("at_risk")
    )
    cumulative = hazard.withColumn("cumulative_hazard", F.sum("hazard").over(earlier))
    return cumulative.select(
        "duration", "events", "cumulative_hazard", F.exp(-F.col("cumulative_hazard")).alias("survival")
    )


def survival_at(model: CoxModel, df: DataFrame, baseline: DataFrame, times: Sequence[float]) -> DataFrame:
    """Survival probability of every row at the given times."""
    steps = baseline.agg(
        *[F.coalesce(F.max(F.when(F.col("duration") <= t, F.col("cumulative_hazard"))), F.lit(0.0)).alias(f"h{i}")
          for i, t in enumerate(times)]
    )
    levels = steps.select(F.array(*[f"h{i}" for i in range(len(times))])).scalar()
    scored = model.partial_hazard(df, "_hazard").withColumn("_levels", levels)
    return scored.withColumn(
        "survival", F.transform("_levels", lambda level: F.exp(-level * F.col("_hazard")))
    ).drop("_hazard", "_levels")

