"""Queries of drift, splits and classifier metrics on labels and scores found in the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.functions.ordered import exact_quantiles
from rackpulse.operators import drift, evaluation as E
from rackpulse.plans import adapters as A
from rackpulse.plans.ctes import sql
from rackpulse.plans.features import _V1, dataset_v1
from rackpulse.plans.kpi import rounded

DRIFT_FEATURES = ("l_quantity", "l_discount", "l_extendedprice")


def scored_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Quality label of a document, with its length squashed to (0, 1) as score."""
    documents = A.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    labels = A.table(spark, sf, "labels").select("doc_id", "quality")
    return documents.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"),
        "lang",
        F.col("quality").alias("label"),
        (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("score"),
    )


def scored_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Returned line items against a score made of quantity and discount; a large table with many ties."""
    return A.table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.col("l_linestatus").alias("status"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_quantity") / 100 + F.col("l_discount")).alias("score"),
    )


_METRICS = ("roc_auc", "pr_auc", "brier", "best_threshold", "precision_at_best_f1", "recall_at_best_f1", "f1_at_best_f1")


def document_metrics(*columns: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(E.ranking_metrics(scored_documents(spark, sf)), 6, *_METRICS).select("n", *columns)

    return run


def metrics_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.ranking_metrics(scored_lines(spark, sf), by=["status"]), 6, *_METRICS)


def precision_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.precision_at_k(scored_documents(spark, sf)), 6, "precision", "lift")


def fold_summary(spark: SparkSession, sf: str) -> DataFrame:
    per_lang = E.ranking_metrics(scored_documents(spark, sf), by=["lang"])
    long = E.long_metrics(per_lang, ("roc_auc", "pr_auc", "brier"), ["lang"])
    return rounded(E.fold_summary(long), 6, "mean", "std")


def score_by_label(spark: SparkSession, sf: str) -> DataFrame:
    df = E.score_by_label(scored_documents(spark, sf))
    return rounded(df, 6, *df.columns)


def time_split(spark: SparkSession, sf: str) -> DataFrame:
    train, test = E.time_based_split(dataset_v1(spark, sf), 0.3)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))).groupBy(
        "part", "window_end_tick"
    ).agg(F.count("*").alias("rows"), F.sum("failed_next_24h").alias("positives"))


def rolling_folds(spark: SparkSession, sf: str) -> DataFrame:
    folds = E.rolling_folds(dataset_v1(spark, sf).select("window_end_tick", "node_id"), 5)
    return folds.select("window_end_tick", "node_id", "test_fold")


def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    weighted = E.class_weights(scored_documents(spark, sf), "label")
    return rounded(weighted.groupBy("label").agg(F.count("*").alias("rows"), F.avg("weight").alias("weight")), 6, "weight")


def survival_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Days from order to shipment; a returned item is an event; quantity is the risk."""
    orders = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return A.table(spark, sf, "lineitem").join(orders, "l_orderkey").select(
        F.expr("timestampdiff(DAY, o_orderdate, l_shipdate)").cast("long").alias("duration"),
        (F.col("l_returnflag") == "R").cast("int").alias("event"),
        F.col("l_quantity").alias("risk"),
        "l_discount",
        "l_tax",
    )


def concordance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.concordance(survival_rows(spark, sf)), 9, "concordance")


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    lines = A.table(spark, sf, "lineitem")
    columns = [F.col(c).cast("double").alias(c) for c in DRIFT_FEATURES]
    early = F.col("l_shipdate") < F.lit("1998-06-01").cast("timestamp_ntz")
    return lines.filter(early).select(*columns), lines.filter(~early).select(*columns)


def quantile_edges(spark: SparkSession, sf: str) -> DataFrame:
    edges = drift.baseline_edges(_halves(spark, sf)[0], DRIFT_FEATURES)
    return rounded(edges, 6, *[f"q{i}" for i in range(11)])


def psi_report(spark: SparkSession, sf: str) -> DataFrame:
    before, after = _halves(spark, sf)
    shifted = after.withColumn("l_quantity", F.col("l_quantity") * 0.8)
    return rounded(drift.psi_report(before, shifted, drift.baseline_edges(before, DRIFT_FEATURES)), 6, "psi")


def value_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Fifth and ninety-fifth percentile of the event value per type."""
    q = exact_quantiles(A.table(spark, sf, "events"), "value", [0.05, 0.95], by=["event_type"])
    return q.select("event_type", F.round(F.col("quantiles")[0], 6).alias("p5"), F.round(F.col("quantiles")[1], 6).alias("p95"))


def batch_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return drift.fingerprint(dataset_v1(spark, sf))


QUERIES = {
    "time_split": time_split,
    "rolling_folds": rolling_folds,
    "class_weights": class_weights,
    "roc_auc": document_metrics("positives", "roc_auc"),
    "average_precision": document_metrics("pr_auc"),
    "brier": document_metrics("brier"),
    "best_f1": document_metrics("best_threshold", "precision_at_best_f1", "recall_at_best_f1", "f1_at_best_f1"),
    "metrics_by_status": metrics_by_status,
    "precision_at_k": precision_at_k,
    "fold_summary": fold_summary,
    "score_by_label": score_by_label,
    "concordance": concordance,
    "quantile_edges": quantile_edges,
    "psi_report": psi_report,
    "value_quantiles": value_quantiles,
    "batch_fingerprint": batch_fingerprint,
}

_DOCS = """
scored as (
  select doc_id as id, lang as grp, quality as label, n_chars / (n_chars + 1000.0::double) as score
  from documents join labels using (doc_id))"""
_LINES = """
scored as (
  select l_linestatus as grp, (l_returnflag = 'R')::int as label, l_quantity / 100 + l_discount as score from lineitem)"""


def _curve(grp: str) -> str:
    """Threshold table and areas per group ``g``."""
    return f""",
cells as (select {grp} as g, score, count(*) filter (label = 1) as pos, count(*) filter (label <> 1) as neg from scored group by all),
tot as (select g, sum(pos) as p, sum(neg) as nn from cells group by g),
cum as (
  select *, sum(pos) over w as cp, sum(neg) over w as cn from cells join tot using (g)
  window w as (partition by g order by score desc)),
pts as (
  select *, cp / (cp + cn) as prec, case when p > 0 then cp / p end as rec from cum),
best as (
  select g, score as thr, prec, rec, round(2 * prec * rec / (prec + rec + 1e-12::double), 12) as f1 from pts
  qualify row_number() over (partition by g order by round(2 * prec * rec / (prec + rec + 1e-12::double), 12) desc, score) = 1),
area as (
  -- Undefined for a single class.
  select g, case when max(p) > 0 and max(nn) > 0 then sum(pos * (nn - cn + neg * 0.5)) / max(p * nn) end as auc,
    case when max(p) > 0 and max(nn) > 0 then sum(pos / p * prec) end as ap from pts group by g),
br as (select {grp} as g, count(*) as n, avg((score - label) ** 2) as brier from scored group by 1),
m as (
  select g, n, p::bigint as positives, round(auc, 6) as roc_auc, round(ap, 6) as pr_auc, round(brier, 6) as brier,
    round(thr, 6) as best_threshold, round(prec, 6) as precision_at_best_f1, round(rec, 6) as recall_at_best_f1,
    round(f1, 6) as f1_at_best_f1, auc, ap, br.brier as raw_brier
  from br join tot using (g) join area using (g) join best using (g))"""


_ALL = "'all'"

_EDGES = "with e as (select * from lineitem where l_shipdate < timestamp '1998-06-01'),\nq as (\n" + "\nunion all ".join(
    f"select '{c}' as feature, " + ", ".join(f"quantile_cont({c}::double, {i / 10}::double) as r{i}" for i in range(11)) + " from e"
    for c in DRIFT_FEATURES
) + "),\nedges as (select feature, r0 as q0, " + ", ".join(
    f"case when r{i} <= q{i - 1} then q{i - 1} + 1e-9::double else r{i} end as q{i}" for i in range(1, 11)
) + " from q)"

_PSI = _EDGES + """,
vals as (
  select 'r' as side, unnest(['l_quantity', 'l_discount', 'l_extendedprice']) as feature,
    unnest([l_quantity::double, l_discount::double, l_extendedprice::double]) as v from e
  union all
  select 'c', unnest(['l_quantity', 'l_discount', 'l_extendedprice']),
    unnest([l_quantity * 0.8::double, l_discount::double, l_extendedprice::double])
  from lineitem where l_shipdate >= timestamp '1998-06-01'),
binned as (
  select side, feature, """ + "case " + " ".join(
    f"when v {'<=' if i == 10 else '<'} q{i} then {i - 1}" for i in range(1, 11)
) + """ end as bin from vals join edges using (feature) where v >= q0 and v <= q10),
grid as (select side, feature, bin from (values ('r'), ('c')) s(side), (select feature from edges), range(10) t(bin)),
share as (
  select g.side, g.feature, g.bin, greatest(count(b.bin) / sum(count(b.bin)) over (partition by g.side, g.feature), 1e-6::double) as s
  from grid g left join binned b on b.side = g.side and b.feature = g.feature and b.bin = g.bin group by g.side, g.feature, g.bin),
psi as (
  select r.feature, sum((c.s - r.s) * ln(c.s / r.s)) as psi from share r join share c
    on r.feature = c.feature and r.bin = c.bin and r.side = 'r' and c.side = 'c' group by 1)
select feature, round(psi, 6) + 0 as psi, case when psi < 0.1 then 'stable' when psi < 0.25 then 'moderate' else 'significant' end
  as severity from psi"""

ORACLES = {
    "time_split": sql(
        _V1,
        """, c as (select quantile_cont(window_end_tick::double, 0.7::double) as cut from v1)
select case when window_end_tick <= cut then 'train' else 'test' end as part, window_end_tick, count(*) as rows,
  cast(sum(failed_next_24h) as bigint) as positives from v1, c group by 1, 2""",
    ),
    "rolling_folds": sql(
        _V1,
        """, r as (select window_end_tick, node_id, row_number() over (order by window_end_tick, node_id) - 1 as i,
  count(*) over () as n from v1)
select window_end_tick, node_id, cast(case when i >= n - 5 * (n // 6) then (i - (n - 5 * (n // 6))) // (n // 6) else -1 end as int)
  as test_fold from r""",
    ),
    "class_weights": sql(
        _DOCS,
        """, p as (select greatest(avg(label), 1e-6::double) as p from scored)
select label, count(*) as rows, round(max(case when label = 1 then 1 / p else 1 / (1 - p + 1e-6::double) end), 6) as weight
from scored, p group by label""",
    ),
    "roc_auc": sql(_DOCS + _curve(_ALL), "select n, positives, roc_auc from m"),
    "average_precision": sql(_DOCS + _curve(_ALL), "select n, pr_auc from m"),
    "brier": sql(_DOCS + _curve(_ALL), "select n, brier from m"),
    "best_f1": sql(
        _DOCS + _curve(_ALL),
        "select n, best_threshold, precision_at_best_f1, recall_at_best_f1, f1_at_best_f1 from m",
    ),
    "metrics_by_status": sql(_LINES + _curve("grp"), "select g as status, m.* exclude (g, auc, ap, raw_brier) from m"),
    "precision_at_k": sql(
        _DOCS,
        """, r as (select label, row_number() over (order by score desc, id) as rn, count(*) over () as n,
  avg(label) over () as rate from scored)
select k::int as k, round(avg(label), 6) as precision, round(avg(label) / greatest(max(rate), 1e-6::double), 6) as lift
from r, (values (10), (25), (50)) t(k) where rn <= k and k <= n group by k""",
    ),
    "fold_summary": sql(
        _DOCS + _curve("grp"),
        """, l as (select 'roc_auc' as metric, auc as v from m union all select 'pr_auc', ap from m union all select 'brier', raw_brier from m)
select metric, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std, count(v) as folds from l group by metric""",
    ),
    "score_by_label": sql(
        _DOCS + _curve(_ALL),
        """select round((select auc from m), 6) as score_auc_vs_label, round(avg(score) filter (label = 1), 6) as score_mean_positive,
  round(avg(score) filter (label = 0), 6) as score_mean_negative from scored""",
    ),
    "concordance": """
with s as (
  select date_diff('day', o_orderdate, l_shipdate) as t, (l_returnflag = 'R')::int as ev, l_quantity as risk, count(*) as n
  from lineitem join orders on l_orderkey = o_orderkey group by all),
p as (
  select a.n * b.n as w, case when a.risk > b.risk then 1.0 when a.risk = b.risk then 0.5 else 0.0 end::double as c
  from s a join s b on a.ev = 1 and (b.t > a.t or (b.t = a.t and b.ev = 0)))
select round(sum(w * c) / sum(w), 9) as concordance, cast(sum(w) as bigint) as comparable_pairs from p""",
    "quantile_edges": _EDGES + "\nselect feature, " + ", ".join(f"round(q{i}, 6) as q{i}" for i in range(11)) + " from edges",
    "psi_report": _PSI,
    "value_quantiles": """select event_type, round(quantile_cont(value, 0.05::double), 6) as p5,
  round(quantile_cont(value, 0.95::double), 6) as p95 from events group by 1""",
}
