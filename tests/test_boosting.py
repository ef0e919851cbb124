"""Boosted trees against SQL and plain loops, and at the edges."""

from __future__ import annotations

import pickle
from itertools import combinations
from math import factorial

import duckdb
import numpy as np
import pytest
from pyspark import RDD
from pyspark.sql import functions as F

from rackpulse.operators import boosting, risk
from rackpulse.operators.boosting import BoostedTrees, HistogramTrees
from rackpulse.operators.window_features import LABEL
from rackpulse.sources import registry

SMALL = {"rounds": 4, "depth": 3, "least_rows": 5, "step": 0.3}


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(600, 3)), 1)
    y = (rng.random(600) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] * (x[:, 2] > 0))))).astype(int)
    return x, y


def table(spark, x, y, weights):
    rows = [([None if np.isnan(v) else float(v) for v in r], int(t), [float(w) for w in ws]) for r, t, ws in zip(x, y, weights, strict=True)]
    return spark.createDataFrame(rows, "x array<double>, label int, weights array<double>").repartition(3)


def plain_fit(x, y, w, rounds, depth, step, l2, least_rows):
    """Margins of boosted trees over all thresholds between values, by loops."""
    share = w[y == 1].sum() / w.sum()
    margin = np.full(len(y), np.log(share / (1 - share)))

    def grow(rows, level):
        g, h = gradient[rows].sum(), hessian[rows].sum()
        best = (1e-9, None, None)
        for f in range(x.shape[1]) if level < depth else ():
            for cut in np.unique(x[rows, f])[:-1]:
                left = rows[x[rows, f] <= cut]
                right = rows[x[rows, f] > cut]
                if min((w[left] > 0).sum(), (w[right] > 0).sum()) < least_rows or min(hessian[left].sum(), hessian[right].sum()) < 1e-3:
                    continue
                gain = gradient[left].sum() ** 2 / (hessian[left].sum() + l2) + gradient[right].sum() ** 2 / (hessian[right].sum() + l2) - g**2 / (h + l2)
                if gain > best[0] + 1e-12:
                    best = (gain, left, right)
        if best[1] is None:
            update[rows] = -step * g / (h + l2)
        else:
            grow(best[1], level + 1)
            grow(best[2], level + 1)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = w * (p - y), w * p * (1 - p)
        update = np.zeros(len(y))
        grow(np.arange(len(y)), 0)
        margin = margin + update
    return margin


def test_side_by_side_models_equal_plain_loops(spark, data):
    x, y = data
    weights = np.ones((600, 3))
    weights[400:, 1] = 0
    weights[y == 1, 2] = 2.5
    models = HistogramTrees(**SMALL).fit_side_by_side(table(spark, x, y, weights))
    for m, model in enumerate(models):
        own = weights[:, m] > 0
        want = plain_fit(x[own], y[own], weights[own, m], SMALL["rounds"], SMALL["depth"], SMALL["step"], 1.0, SMALL["least_rows"])
        assert model.margin(x[own]) == pytest.approx(want, abs=1e-9)
    alone = HistogramTrees(**SMALL).fit_side_by_side(table(spark, x, y, weights[:, 1:2]))[0]
    assert alone.margin(x) == pytest.approx(models[1].margin(x), abs=1e-9)


@pytest.mark.parametrize("l2", [0.0, 1.0, 50.0])
def test_first_split_equals_sql(spark, data, l2):
    x, y = data
    model = HistogramTrees(rounds=1, depth=1, l2=l2, least_rows=20, step=1.0).fit_side_by_side(table(spark, x, y, np.ones((600, 1))))[0]
    con = duckdb.connect()
    con.execute("create table t(f0 double, f1 double, f2 double, y int)")
    con.executemany("insert into t values (?, ?, ?, ?)", [(*map(float, r), int(t)) for r, t in zip(x, y, strict=True)])
    feature, cut, left, right = con.execute(
        f"""with p as (select avg(y) as p from t),
long as (select 0 as f, f0 as v, y from t union all select 1, f1, y from t union all select 2, f2, y from t),
cells as (select f, v, sum(p - y) as g, sum(p * (1 - p)) as h, count(*) as n from long, p group by f, v),
sums as (select f, v, sum(g) over w as gl, sum(h) over w as hl, sum(n) over w as nl, sum(g) over t as g, sum(h) over t as h, sum(n) over t as n
  from cells window w as (partition by f order by v), t as (partition by f))
select f, v, -gl / (hl + {l2}), -(g - gl) / (h - hl + {l2}) from sums where nl >= 20 and n - nl >= 20
order by round(gl * gl / (hl + {l2}) + (g - gl) * (g - gl) / (h - hl + {l2}) - g * g / (h + {l2}), 9) desc, f, v limit 1"""
    ).fetchone()
    tree = model.trees[0]
    assert (tree.feature[0], model.edges[feature][tree.bin[0] - 1]) == (feature, cut)
    assert tree.value[1:3] == pytest.approx([left, right], abs=1e-9)


@pytest.mark.parametrize("parts", [2, 6])
def test_driver_gets_a_row_per_node_however_many_features_bins_and_tasks(spark, data, monkeypatch, parts):
    x, y = data
    wide = np.concatenate([x + i for i in range(8)], axis=1)
    received = []
    collect = RDD.collect

    def spy(self):
        found = collect(self)
        received.append(len(pickle.dumps(found)))
        return found

    monkeypatch.setattr(RDD, "collect", spy)
    rows = table(spark, wide, y, np.ones((600, 2))).repartition(parts)
    HistogramTrees(rounds=1, depth=3, least_rows=5, step=0.3).fit_side_by_side(rows)
    # Two models of at most 15 nodes each, in four jobs; the sums of one node alone are over 10,000 bytes.
    assert len(received) == 4 and sum(received) < 10_000


def test_models_of_small_tables_take_one_job_and_get_the_trees_of_level_jobs(spark, data, monkeypatch):
    x, y = data[0].copy(), data[1]
    x[::7, 0] = np.nan
    weights = np.ones((600, 4))
    weights[400:, 1] = 0
    weights[y == 1, 2] = 2.5
    weights[y == 0, 3] = 0
    # Blocks of a few dozen rows, several in a part.
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 50)
    rows = table(spark, x, y, weights).repartition(5).persist()
    rows.count()
    received = []
    collect = RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda self: received.append(self) or collect(self))
    together = HistogramTrees(rounds=12, depth=4, least_rows=5, step=0.9).fit_side_by_side(rows)
    assert len(received) == 1
    monkeypatch.setattr(boosting, "TASK_BYTES", 0)
    apart = HistogramTrees(rounds=12, depth=4, least_rows=5, step=0.9).fit_side_by_side(rows)
    rows.unpersist()
    assert len(received) > 12
    for one, other in zip(together, apart, strict=True):
        assert len(one.trees) == len(other.trees) and one.base == other.base
        for a, b in zip(one.trees, other.trees, strict=True):
            assert all((getattr(a, part) == getattr(b, part)).all() for part in ("feature", "bin", "value", "cover"))
    assert len(together[0].trees) == 12 and not together[3].trees


def test_missing_values_one_class_and_no_rows(spark, data):
    x, y = data[0].copy(), data[1]
    x[::7, 0] = np.nan
    weights = np.ones((600, 3))
    weights[y == 0, 1] = 0
    weights[:, 2] = 0
    models = HistogramTrees(**SMALL).fit_side_by_side(table(spark, x, y, weights))
    low = np.where(np.isnan(x), -1e9, x)
    assert models[0].margin(x) == pytest.approx(plain_fit(low, y, weights[:, 0], 4, 3, 0.3, 1.0, 5), abs=1e-9)
    assert not models[1].trees and not models[2].trees
    assert models[1].margin(x)[0] > 10 and models[2].margin(x)[0] == 0
    assert HistogramTrees(**SMALL).fit_side_by_side(table(spark, x[:0], y[:0], weights[:0]))[0].trees == []


def test_saved_trees_and_calibration_score_alike(spark, data, tmp_path):
    x, y = data
    rows = spark.createDataFrame([(i * 10, f"node-{i:04d}", *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], f"window_end_tick long, node_id string, a double, b double, c double, {LABEL} int")
    model = risk.fit_calibrated(rows, ["a", "b", "c"], risk.boosted_trees(**SMALL))
    root = str(tmp_path / "registry")
    assert registry.load_risk_model(spark, root) is None
    registry.register_risk_model(spark, root, model, rows)
    version, again = registry.load_risk_model(spark, root)
    want = {r.node_id: r.score for r in model.score(rows).collect()}
    assert version == 1 and {r.node_id: r.score for r in again.score(rows).collect()} == want
    assert again.classifier.margin(x) == pytest.approx(model.classifier.margin(x), abs=0)
    assert isinstance(again.classifier, BoostedTrees)


def test_two_writers_get_two_versions(spark, tmp_path):
    root = str(tmp_path / "registry")
    # Both look at the same empty index.
    assert [registry.claim_version(spark, root), registry.claim_version(spark, root)] == [1, 2]


def test_folds_side_by_side_equal_folds_alone(spark, data):
    # Few distinct values, so that the quantiles of all rows and of a fold's rows are the same bins.
    x, y = np.round(data[0]), data[1]
    rows = [(w, f"node-{n:02d}", *map(float, x[w * 10 + n]), int(y[w * 10 + n])) for w in range(60) for n in range(10)]
    dataset = spark.createDataFrame(rows, f"window_end_tick long, node_id string, a double, b double, c double, {LABEL} int")
    estimator = risk.boosted_trees(**SMALL)
    together = risk.cross_validate(dataset, ["a", "b", "c"], 3, estimator)

    class Alone:
        def fit(self, packed):
            return estimator.fit(packed)

    alone = risk.cross_validate(dataset, ["a", "b", "c"], 3, Alone())
    key = lambda r: (r.fold, r.window_end_tick, r.node_id)
    got, want = ({key(r): r.score for r in t.collect()} for t in (together, alone))
    assert got == pytest.approx(want, abs=1e-9)


def test_bins_hold_every_value_of_few(spark):
    rows = spark.createDataFrame([([float(i % 9), None],) for i in range(100)], "x array<double>")
    first, second = boosting.bin_edges(rows.withColumn("y", F.lit(1)), 2, 255)
    assert first.tolist() == list(map(float, range(9))) and second.tolist() == []


def test_attribution_equals_shapley_values_of_all_subsets(spark, data):
    x, y = data
    model = HistogramTrees(rounds=3, depth=4, least_rows=10, step=0.5).fit_side_by_side(table(spark, x, y, np.ones((600, 1))))[0]
    rows = np.vstack((x[:12], [[np.nan, 0.0, np.nan]]))
    bins = boosting.to_bins(rows, model.edges)

    def worth(known, column):
        def mean(tree, node):
            f = tree.feature[node]
            if f < 0:
                return tree.value[node]
            left, right = 2 * node + 1, 2 * node + 2
            if f in known:
                return mean(tree, right if bins[f, column] > tree.bin[node] else left)
            return (tree.cover[left] * mean(tree, left) + tree.cover[right] * mean(tree, right)) / tree.cover[node]

        return sum(mean(tree, 0) for tree in model.trees)

    got = model.attribution(rows)
    for column in range(len(rows)):
        for f in range(3):
            others = [o for o in range(3) if o != f]
            want = sum(
                factorial(n) * factorial(2 - n) / factorial(3) * (worth({*s, f}, column) - worth(set(s), column))
                for n in range(3) for s in combinations(others, n)
            )
            assert got[column, f] == pytest.approx(want, abs=1e-12)
    assert got.sum(axis=1) + model.expected() == pytest.approx(model.margin(rows), abs=1e-9)


def test_shares_of_all_trees_are_computed_together(monkeypatch):
    rng = np.random.default_rng(5)

    def grown(tree, node, level, cover):
        tree.cover[node], tree.value[node] = cover, rng.normal()
        if level < 4:
            tree.feature[node], tree.bin[node] = rng.integers(5), rng.integers(1, 30)
            share = rng.uniform(0.1, 0.9)
            grown(tree, 2 * node + 1, level + 1, cover * share)
            grown(tree, 2 * node + 2, level + 1, cover * (1 - share))
        return tree

    trees = [grown(boosting.Tree.leaf(4), 0, 0, 100.0) for _ in range(40)] + [boosting.Tree.leaf(4)]
    calls = []
    shares = boosting._shapley_shares
    monkeypatch.setattr(boosting, "_shapley_shares", lambda *given: calls.append(given) or shares(*given))
    paths = BoostedTrees([], trees, 0.0, 4).paths()
    assert len(paths) == 641 and len(calls) <= 7
    for kept, value in ((kept, value) for group in calls for kept, value in zip(*group, strict=True)):
        n = len(kept)
        got = shares(kept[None], np.array([value]))[0]
        for pattern in range(1 << n):
            worth = lambda known, p=pattern: value * np.prod([float(p >> k & 1) if k in known else kept[k] for k in range(n)])  # noqa: B023, E731
            for i in range(n):
                others = [k for k in range(n) if k != i]
                want = sum(factorial(m) * factorial(n - m - 1) / factorial(n) * (worth({*s, i}) - worth(set(s))) for m in range(n) for s in combinations(others, m))
                assert got[pattern, i] == pytest.approx(want, abs=1e-12)
        if n == 4:
            break


def test_contributions_of_full_trees_add_up(spark, data):
    x, y = data
    rows = spark.createDataFrame([(i, f"node-{i:04d}", *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], f"window_end_tick long, node_id string, a double, b double, c double, {LABEL} int")
    model = risk.fit(rows, ["a", "b", "c"], risk.boosted_trees(rounds=20))
    told = risk.contributions(model, rows, rows).groupBy("window_end_tick").agg(F.sum("contribution").alias("total")).collect()
    margin = model.classifier.margin(x)
    assert all(r.total + model.classifier.expected() == pytest.approx(margin[r.window_end_tick], abs=1e-9) for r in told) and len(told) == 600
