from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from rackpulse.functions.graph import connected_components
from rackpulse.functions.ordered import exact_quantiles, running_totals
from rackpulse.operators import drift, evaluation as E


def test_running_totals_over_a_dominant_group(spark):
    rng = np.random.default_rng(0)
    rows = [("hot", int(v), int(rng.integers(1, 9))) for v in rng.permutation(3000)]
    rows += [(f"g{v % 7}", int(v), 1) for v in range(700)]
    df = spark.createDataFrame(rows, "g string, v long, m long")
    got = {(r.g, r.v): r.cum_m for r in running_totals(df, ["v"], ["m"], by=["g"], buckets=40).collect()}
    assert len(got) == len(rows)
    for group in {r[0] for r in rows}:
        total = 0
        for _, v, m in sorted(r for r in rows if r[0] == group):
            total += m
            assert got[group, v] == total


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = np.round(rng.normal(size=997), 2), np.repeat([1.0, 2.0], [400, 3])
    df = spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b], "f string, x double")
    probabilities = [0, 0.05, 0.31, 0.5, 0.95, 1]
    got = {r.f: r.quantiles for r in exact_quantiles(df, "x", probabilities, by=["f"]).collect()}
    assert got["a"] == pytest.approx(list(np.quantile(a, probabilities)))
    assert got["b"] == pytest.approx(list(np.quantile(b, probabilities)))
    assert exact_quantiles(df, "x", [0.5]).first().quantiles == pytest.approx([np.quantile(np.concatenate([a, b]), 0.5)])


def test_components(spark):
    pairs = [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)] + [("900", "901"), ("901", "902")]
    both = pairs + [(b, a) for a, b in pairs]
    edges = spark.createDataFrame(both, "src string, dst string")
    vertices = spark.createDataFrame([(v,) for v in {x for p in pairs for x in p} | {"zzz"}], "id string")
    got = {r.id: r.label for r in connected_components(vertices, edges).collect()}
    assert {v for k, v in got.items() if k < "100"} == {"000"}
    assert (got["902"], got["zzz"]) == ("900", "zzz")


def scored(spark, rng, n=400):
    y = rng.integers(0, 2, n)
    s = np.round(rng.normal(size=n) + y * 0.7, 1)
    return y, s, spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s, strict=True))],
                                       "id long, label int, score double")


def test_ranking_metrics_against_pairs(spark):
    y, s, df = scored(spark, np.random.default_rng(2))
    row = E.ranking_metrics(df).first()
    pos, neg = s[y == 1], s[y == 0]
    wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    assert row.roc_auc == pytest.approx(wins / (len(pos) * len(neg)))
    thresholds = np.unique(s)[::-1]
    precision = [y[s >= t].mean() for t in thresholds]
    recall = [y[s >= t].sum() / y.sum() for t in thresholds]
    steps = np.diff([0, *recall])
    assert row.pr_auc == pytest.approx(float((steps * precision).sum()))
    f1 = [2 * p * r / (p + r + 1e-12) for p, r in zip(precision, recall, strict=True)]
    assert row.f1_at_best_f1 == pytest.approx(max(f1))
    assert row.brier == pytest.approx(((s - y) ** 2).mean())


def test_single_class_has_no_areas(spark):
    row = E.ranking_metrics(spark.createDataFrame([(1, 0.5), (1, 0.7)], "label int, score double")).first()
    assert row.roc_auc is None and row.pr_auc is None and row.n == 2


def test_precision_at_k_skips_what_it_cannot_fill(spark):
    rows = [(i, int(i < 6), 1 - i / 100) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, label int, score double")
    got = {r.k: (r.precision, r.lift) for r in E.precision_at_k(df).collect()}
    assert got == {10: (pytest.approx(0.6), pytest.approx(2.0))}


def test_concordance_against_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(1, 12)), int(rng.integers(0, 2)), int(rng.integers(0, 6))) for _ in range(300)]
    comparable, concordant = 0, 0.0
    for (t1, e1, r1), (t2, e2, r2) in itertools.permutations(rows, 2):
        if e1 and (t2 > t1 or (t2 == t1 and not e2)):
            comparable += 1
            concordant += 1.0 if r1 > r2 else 0.5 if r1 == r2 else 0.0
    row = E.concordance(spark.createDataFrame(rows, "duration long, event int, risk long")).first()
    assert row.comparable_pairs == comparable
    assert row.concordance == pytest.approx(concordant / comparable)


def test_rolling_folds_equal_slices(spark):
    n, k = 53, 4
    rows = [(i // 7, f"n{i % 7}") for i in range(n)]
    folded = E.rolling_folds(spark.createDataFrame(rows, "window_end_tick long, node_id string"), k)
    order = [r.test_fold for r in folded.orderBy("window_end_tick", "node_id").collect()]
    size = n // (k + 1)
    expected = [-1] * (n - k * size) + [f for f in range(k) for _ in range(size)]
    assert order == expected


def test_time_split_never_overlaps(spark):
    df = spark.createDataFrame([(t, i) for t in range(10) for i in range(t + 1)], "window_end_tick long, i int")
    train, test = E.time_based_split(df, 0.3)
    assert train.count() + test.count() == df.count()
    assert train.agg(F.max("window_end_tick")).first()[0] < test.agg(F.min("window_end_tick")).first()[0]


def test_class_weights_balance(spark):
    df = spark.createDataFrame([(1,)] * 2 + [(0,)] * 8, "label int")
    sums = {r.label: r.w for r in E.class_weights(df, "label").groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    assert sums[0] == pytest.approx(sums[1], rel=1e-4)


def psi_by_hand(reference, current, edges):
    r, c = np.histogram(reference, edges)[0], np.histogram(current, edges)[0]
    r, c = (np.clip(x / max(x.sum(), 1), 1e-6, None) for x in (r, c))
    return float(((c - r) * np.log(c / r)).sum())


def test_drift(spark):
    rng = np.random.default_rng(4)
    base = spark.createDataFrame([(float(a), float(b), 1.0) for a, b in rng.normal(size=(1000, 2))], "f1 double, f2 double, c double")
    moved = base.withColumn("f1", F.col("f1") + 3)
    edges = drift.baseline_edges(base, ["f1", "f2", "c"])
    rows = {r.feature: r for r in edges.collect()}
    constant = [rows["c"][f"q{i}"] for i in range(11)]
    assert all(b > a for a, b in itertools.pairwise(constant))
    same = {r.feature: r.psi for r in drift.psi_report(base, base, edges).collect()}
    assert all(abs(v) < 1e-6 for v in same.values())
    report = {r.feature: r for r in drift.psi_report(base, moved, edges).collect()}
    assert report["f1"].severity == "significant" and report["f2"].severity == "stable"
    f1 = np.array([r.f1 for r in base.collect()])
    cuts = [rows["f1"][f"q{i}"] for i in range(11)]
    assert report["f1"].psi == pytest.approx(psi_by_hand(f1, f1 + 3, cuts))


def test_fingerprint_ignores_order_and_sees_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "i int, s string")
    b = spark.createDataFrame([(2, "y"), (1, "x")], "i int, s string")
    c = spark.createDataFrame([(2, "y"), (1, "z")], "i int, s string")
    assert drift.fingerprint(a).first() == drift.fingerprint(b).first()
    assert drift.fingerprint(a).first() != drift.fingerprint(c).first()


@pytest.mark.parametrize("partitions", [4, 60])
def test_quantiles_with_a_dominant_value_and_null_groups(spark, partitions):
    rng = np.random.default_rng(5)
    groups = {"hot": np.concatenate([np.full(4000, 0.5), rng.normal(size=3000)]), None: rng.normal(size=501), "one": np.array([3.0])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("hot", None), ("empty", None)]
    probabilities = [0.0, 0.1, 0.333, 0.5, 0.95, 1.0]
    df = spark.createDataFrame(rows, "g string, x double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = {r.g: r.quantiles for r in exact_quantiles(df, "x", probabilities, by=["g"]).collect()}
        whole = exact_quantiles(df, "x", probabilities).first().quantiles
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got.keys() == groups.keys()
    for g, values in groups.items():
        assert got[g] == pytest.approx(list(np.quantile(values, probabilities)))
    assert whole == pytest.approx(list(np.quantile(np.concatenate(list(groups.values())), probabilities)))
    assert exact_quantiles(df.limit(0), "x", [0.5], by=["g"]).count() == 0
