"""Isolation forest: trees grown on small hashed subsamples, all rows scored in parallel."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.functions.ordered import exact_quantiles
from rackpulse.functions.scaling import apply_scaler, fit_scaler
from rackpulse.operators import evaluation as E
from rackpulse.operators.window_features import LABEL
from rackpulse.session import cut_lineage

# Forest size, rows per tree, quantiles that map the raw score to [0, 1].
TREES = 200
SUBSAMPLE = 256
LOW, HIGH = 0.05, 0.95

TREE = "tree int, node int, feature int, threshold double, depth int, size int"


@dataclass
class AnomalyModel:
    """Trees (a table of at most TREES * 2 * SUBSAMPLE rows), scaler and the raw-score range of the training rows."""

    trees: DataFrame
    scaler: DataFrame
    features: list[str]
    sample_size: int
    low: float
    high: float


def expected_path(size):
    """Mean path length of an unsuccessful search among ``size`` points."""
    size = np.asarray(size, dtype=float)
    harmonic = np.log(np.maximum(size - 1, 1)) + np.euler_gamma
    return np.where(size > 2, 2 * harmonic - 2 * (size - 1) / np.maximum(size, 1), np.where(size == 2, 1.0, 0.0))


def _grow(seed: int, limit: int):
    """Group function: one random isolation tree as rows; children of node i are 2i + 1 and 2i + 2."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        points = np.stack(pdf.sort_values("pick")["x"].to_numpy())[:SUBSAMPLE]
        rng = np.random.default_rng([seed, tree])
        rows, todo = [], [(0, 0, points)]
        while todo:
            node, depth, part = todo.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            choices = np.flatnonzero(high > low)
            if depth >= limit or len(part) <= 1 or not len(choices):
                rows.append((tree, node, -1, 0.0, depth, len(part)))
                continue
            feature = int(rng.choice(choices))
            # Strictly below the maximum, so that both children get rows.
            threshold = min(rng.uniform(low[feature], high[feature]), np.nextafter(high[feature], low[feature]))
            left = part[:, feature] <= threshold
            rows.append((tree, node, feature, float(threshold), depth, len(part)))
            todo += [(2 * node + 1, depth + 1, part[left]), (2 * node + 2, depth + 1, part[~left])]
        return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "depth", "size"])

    return grow


def subsamples(rows: DataFrame, keys: Sequence[str], trees: int, seed: int) -> DataFrame:
    """Rows with the tree they help to grow and their random order in it.

    The hash of its keys puts a row into one of as many slots as there are rows, one row a slot on average. Every tree draws
    distinct slots for one and a half subsamples, all of them if there are fewer. The draws are ``trees * 1.5 * SUBSAMPLE``
    rows at most, whatever the length of the table, and are broadcast: each row is looked up once and only rows that a tree
    drew leave the scan. The keys must tell rows apart.
    """
    slots = max(rows.count(), 1)
    wanted = min(slots, 3 * SUBSAMPLE // 2)
    rng = np.random.default_rng([seed, trees])
    drawn = pd.DataFrame(
        {"tree": np.repeat(np.arange(trees, dtype=np.int32), wanted),
         "slot": np.concatenate([rng.choice(slots, wanted, replace=False) for _ in range(trees)])}
    )
    draws = F.broadcast(rows.sparkSession.createDataFrame(drawn, "tree int, slot long"))
    placed = rows.withColumn("slot", F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(slots)))
    return placed.join(draws, "slot").drop("slot").withColumn("pick", F.xxhash64(F.lit(seed), F.col("tree"), *keys))


def train_anomaly_detector(
    dataset: DataFrame,
    features: Sequence[str],
    test_fraction: float = 0.3,
    trees: int = TREES,
    seed: int = 42,
    keys: Sequence[str] = ("window_end_tick", "node_id"),
) -> AnomalyModel:
    """Forest on the healthy windows of the training period, in standardised feature space."""
    train = E.time_based_split(dataset, test_fraction)[0].filter(F.col(LABEL) == 0)
    train = cut_lineage(train.select(*keys, *[F.col(c).cast("double").alias(c) for c in features]))
    scaler = cut_lineage(fit_scaler(train, features))
    packed = _packed(apply_scaler(train, scaler, features), features, keys)
    sample = subsamples(packed, keys, trees, seed)
    limit = int(np.ceil(np.log2(SUBSAMPLE)))
    grown = cut_lineage(sample.groupBy("tree").applyInPandas(_grow(seed, limit), TREE))
    size = grown.filter("node = 0").agg(F.avg("size")).first()[0]
    if size is None:
        raise ValueError("no healthy rows to train on")
    model = AnomalyModel(grown, scaler, list(features), max(round(size), 2), 0.0, 1.0)
    edges = exact_quantiles(raw_scores(model, train), "raw", [LOW, HIGH]).first()["quantiles"]
    model.low, model.high = edges
    return model


def _packed(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, F.array(*features).alias("x"))


def raw_scores(model: AnomalyModel, df: DataFrame) -> DataFrame:
    """Isolation score 2 ** (-mean path / expected path) per row, higher is more anomalous.

    The trees have a fixed maximum size and are sent to every task; rows stream through in Arrow batches.
    """
    forest = [part for _, part in model.trees.toPandas().groupby("tree")]
    norm = float(expected_path(model.sample_size))
    shared = df.sparkSession.sparkContext.broadcast([_arrays(t) for t in forest])
    keep = [c for c in df.columns if c not in model.features]
    scaled = apply_scaler(
        df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in model.features}),
        model.scaler, model.features,
    )
    packed = _packed(scaled, model.features, keep)
    schema = packed.drop("x").withColumn("raw", F.lit(0.0)).schema

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy())
                path = sum(_path_lengths(x, *arrays) for arrays in shared.value) / len(shared.value)
                yield pdf.drop(columns="x").assign(raw=2.0 ** (-path / norm))

    return packed.mapInPandas(score, schema)


def _arrays(tree: pd.DataFrame):
    """Tree as arrays indexed by node number."""
    top = int(tree["node"].max()) + 1
    feature, threshold, leaf = np.full(top, -1), np.zeros(top), np.zeros(top)
    node = tree["node"].to_numpy()
    feature[node], threshold[node] = tree["feature"], tree["threshold"]
    leaf[node] = tree["depth"].to_numpy() + expected_path(tree["size"].to_numpy())
    return feature, threshold, leaf


def _path_lengths(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """Depth reached by every row, moving all rows down one level at a time."""
    at = np.zeros(len(x), dtype=int)
    rows = np.arange(len(x))
    while True:
        split = feature[at]
        inner = split >= 0
        if not inner.any():
            return leaf[at]
        right = x[rows[inner], split[inner]] > threshold[at[inner]]
        at[inner] = 2 * at[inner] + 1 + right


def normalise(scores: DataFrame, low, high, raw: str = "raw", column: str = "anomaly_score") -> DataFrame:
    """Raw score on [0, 1] between two reference values."""
    span = F.greatest(F.lit(high) - F.lit(low), F.lit(1e-9))
    return scores.withColumn(column, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(raw) - F.lit(low)) / span)))


def anomaly_scores(model: AnomalyModel, df: DataFrame, batch_range: bool = False) -> DataFrame:
    """Anomaly score in [0, 1] per row.

    The scale comes from the training rows; ``batch_range=True`` takes it from the scored batch itself, as published,
    which makes a single-row batch always 0.
    """
    scored = raw_scores(model, df)
    if not batch_range:
        return normalise(scored, model.low, model.high)
    scored = cut_lineage(scored)
    low, high = exact_quantiles(scored, "raw", [LOW, HIGH]).first()["quantiles"]
    return normalise(scored, low, high)


def evaluate_anomaly(model: AnomalyModel, dataset: DataFrame) -> DataFrame:
    scored = cut_lineage(anomaly_scores(model, dataset).select(F.col(LABEL).alias("label"), "anomaly_score"))
    return E.score_by_label(scored, score="anomaly_score")
