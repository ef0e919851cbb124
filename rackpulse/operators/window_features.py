"""Sliding-window statistics of telemetry and the labelled data sets built from them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rackpulse.functions.columns import node_of_gpu
from rackpulse.functions.windows import Hops, all_windows, last_tick, open_chunks, to_chunks, to_windows
from rackpulse.schemas import (
    COMPONENT_KINDS,
    COUNTERS,
    KINDS,
    LEVELS,
    PRECURSOR_KINDS,
    RATES,
    SEVERITIES,
    SIGNALS,
    STATS,
    TICKS_PER_HOUR,
)

LABEL = "failed_next_24h"
IDS = ("node_id", "rack_id", "zone_id", "window_end_tick")
SERIES = ("gpu_id", "_chunk", "window_end_tick")
TOLERANCE = 1e-9
ROLLING_MIN = 6
BLOCK = 256

# Feature columns of the count-based data set.
PRECURSORS = ("ecc_uncorrectable_info", "nvlink_fault_warn", "pcie_error_warn")
V1_FEATURES = (
    *[f"n_{k}" for k in KINDS],
    *[f"sev_{s}" for s in SEVERITIES],
    *PRECURSORS,
    "util_mean", "util_max", "util_std", "zone_events_in_window", "rack_thermal_stress", "window_age_days",
)
SIGNAL_FEATURES = tuple(f"{signal}__{stat}" for signal in SIGNALS for stat in STATS)
EVENT_FEATURES = tuple(f"ev_{kind}_{severity}" for kind in PRECURSOR_KINDS for severity in SEVERITIES)
V2_FEATURES = SIGNAL_FEATURES + EVENT_FEATURES


def feature_columns(dataset: DataFrame) -> list[str]:
    """All columns that are neither ids nor the label."""
    return [c for c in dataset.columns if c not in (*IDS, LABEL)]


def _increase(counter: Column, before: Column) -> Column:
    """Growth of a monotone counter; a reset, or no earlier sample, counts as 0."""
    return F.coalesce(F.greatest(counter - before, F.lit(0).cast("long")), F.lit(0).cast("long"))


def counter_rates(metrics: DataFrame) -> DataFrame:
    """Metrics with per-sample counter increases over the whole history of each GPU (one row per tick)."""
    history = W.partitionBy("gpu_id").orderBy("tick")
    return metrics.withColumns(
        {rate: _increase(F.col(c), F.lag(c).over(history)) for c, rate in zip(COUNTERS, RATES, strict=True)}
    )


def _describe(values: np.ndarray) -> np.ndarray:
    """The ten statistics along the last axis, stacked behind it in their published order."""
    n = values.shape[-1]
    mean = values.mean(axis=-1, keepdims=True)
    centred = values - mean
    std = values.std(axis=-1, keepdims=True)
    low, high = values.min(axis=-1), values.max(axis=-1)
    slope = correlation = np.zeros(values.shape[:-1])
    if n >= 2:
        place = np.arange(n) - (n - 1) / 2
        slope = centred @ place / (place @ place)
        a, b = values[..., :-1], values[..., 1:]
        a, b = a - a.mean(axis=-1, keepdims=True), b - b.mean(axis=-1, keepdims=True)
        scatter = np.sqrt((a * a).sum(axis=-1)) * np.sqrt((b * b).sum(axis=-1))
        correlation = (a * b).sum(axis=-1) / (scatter + 1e-12)
    spikes = (values > mean + 2 * std + TOLERANCE).sum(axis=-1)
    peak = _rolling_peak(centred) if n >= ROLLING_MIN else std[..., 0]
    columns = (mean[..., 0], std[..., 0], low, high, high - low, slope, correlation, spikes, values[..., -1], peak)
    return np.stack(columns, axis=-1)


def _rolling_peak(centred: np.ndarray) -> np.ndarray:
    """Largest sample deviation over max(3, n / 6) consecutive values: found by prefix sums, then taken directly."""
    n = centred.shape[-1]
    w = max(3, n // 6)
    zero = np.zeros((*centred.shape[:-1], 1))
    first = np.concatenate([zero, centred.cumsum(axis=-1)], axis=-1)
    second = np.concatenate([zero, (centred**2).cumsum(axis=-1)], axis=-1)
    scatter = second[..., w:] - second[..., :-w] - (first[..., w:] - first[..., :-w]) ** 2 / w
    start = scatter.argmax(axis=-1)[..., None]
    return np.take_along_axis(centred, start + np.arange(w), axis=-1).std(axis=-1, ddof=1)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def series_statistics(*signals: pd.Series) -> pd.Series:
    """All statistics of all signals of a window in one flat array; windows of equal length are computed together."""
    lengths = signals[0].map(len).to_numpy()
    result = np.empty((len(lengths), len(signals) * len(STATS)))
    for n in np.unique(lengths):
        same = np.flatnonzero(lengths == n)
        for at in np.array_split(same, -(-len(same) // BLOCK)):
            block = np.stack([np.stack(s.iloc[at].to_numpy()) for s in signals], axis=1)
            stats = _describe(block)
            # A missing sample is left out of its own signal only.
            for row, signal in np.argwhere(np.isnan(block).any(axis=2)):
                known = block[row, signal][~np.isnan(block[row, signal])]
                stats[row, signal] = _describe(known[None, None])[0, 0] if len(known) else np.nan
            result[at] = stats.reshape(len(at), -1)
    return pd.Series(list(result))


def gpu_window_stats(
    metrics: DataFrame,
    hops: Hops,
    max_tick: Column | None = None,
    signals: tuple[str, ...] = SIGNALS,
    windows_per_chunk: int | None = None,
) -> DataFrame:
    """Ten statistics of every signal per (GPU, window), as columns ``signal__stat``.

    The samples are exchanged once, then gathered per window as one array in time order: a window holds at most the
    samples of its look-back. Counters become rates inside each window, so its first sample has rate 0. The arrays go
    through one Arrow function: as grouped aggregates the statistics are some 150 buffer columns plus a frame whose
    length differs per window, as array expressions a dozen interpreted passes; both took many times longer.
    """
    ends = max_tick if max_tick is not None else last_tick(metrics)
    chunked = to_chunks(metrics.select("tick", "gpu_id", *LEVELS, *COUNTERS), hops, ends, "gpu_id", windows_per_chunk)
    rows = F.array_sort(F.collect_list(F.struct("tick", *COUNTERS, *LEVELS)))
    gathered = open_chunks(chunked, hops).groupBy(*SERIES).agg(rows.alias("rows"))
    described = gathered.withColumn("stats", series_statistics(*[_values(s) for s in signals]))
    return described.select(
        node_of_gpu(F.col("gpu_id")).alias("node_id"),
        "gpu_id",
        "window_end_tick",
        *[
            F.get("stats", F.lit(place)).alias(name)
            for place, name in enumerate(f"{s}__{stat}" for s in signals for stat in STATS)
        ],
    )


def _values(signal: str) -> Column:
    """Values of a signal in time order; a rate is the growth of its counter since the previous sample."""
    if signal in LEVELS:
        return F.col(f"rows.{signal}")
    counter = COUNTERS[RATES.index(signal)]

    def rate(row: Column, i: Column) -> Column:
        return F.when(i == 0, 0).otherwise(F.greatest(row[counter] - F.get("rows", i - 1)[counter], F.lit(0)))

    return F.transform("rows", lambda row, i: F.coalesce(rate(row, i), F.lit(0)).cast("double"))


def node_window_stats(metrics: DataFrame, hops: Hops, max_tick: Column | None = None) -> DataFrame:
    """Worst GPU of each node: the maximum of every statistic."""
    stats = gpu_window_stats(metrics, hops, max_tick)
    return stats.groupBy("node_id", "window_end_tick").agg(*[F.max(c).alias(c) for c in SIGNAL_FEATURES])


def precursor_counts(enriched: DataFrame, hops: Hops, max_tick: Column) -> DataFrame:
    """Twelve (kind, severity) event counts per (node, window)."""
    wanted = enriched.filter(F.col("node_id").isNotNull() & F.col("kind").isin(*PRECURSOR_KINDS)).select(
        "tick", "node_id", "kind", "severity"
    )
    return to_windows(wanted, hops, max_tick).groupBy("node_id", "window_end_tick").agg(
        *[
            F.count_if((F.col("kind") == k) & (F.col("severity") == s)).alias(f"ev_{k}_{s}")
            for k in PRECURSOR_KINDS
            for s in SEVERITIES
        ]
    )


def window_labels(enriched: DataFrame, hops: Hops, max_tick: Column) -> DataFrame:
    """(node, window) pairs with a critical component event in [end, end + horizon)."""
    critical = enriched.filter(
        (F.col("severity") == "critical") & F.col("kind").isin(*COMPONENT_KINDS) & F.col("node_id").isNotNull()
    ).select("tick", "node_id")
    return (
        to_windows(critical, hops, max_tick, ahead=True)
        .groupBy("node_id", "window_end_tick")
        .agg(F.count("*").alias("critical_events"), F.min("tick").alias("first_event_tick"))
    )


def _zero_filled(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in columns})


def build_timeseries_dataset(
    metrics: DataFrame, enriched: DataFrame, fleet: DataFrame, hops: Hops | None = None
) -> DataFrame:
    """72 features, label and topology per (node, window) that has metrics."""
    hops = hops or Hops.hours()
    top = last_tick(metrics, enriched)
    keys = ["node_id", "window_end_tick"]
    dataset = (
        node_window_stats(metrics, hops, top)
        .join(precursor_counts(enriched, hops, top), keys, "left")
        .join(window_labels(enriched, hops, top).withColumn(LABEL, F.lit(1)).drop("critical_events"), keys, "left")
    )
    topology = fleet.select("node_id", "rack_id", "zone_id")
    return (
        _zero_filled(dataset, (*V2_FEATURES, LABEL))
        .select(*keys, *V2_FEATURES, LABEL, "first_event_tick")
        .join(topology, "node_id", "left")
        .select(*keys, *V2_FEATURES, LABEL, "rack_id", "zone_id", "first_event_tick")
    )


def with_known_labels(dataset: DataFrame, events: DataFrame, hops: Hops) -> DataFrame:
    """Windows whose look-ahead ends before the last event: later ones cannot be told healthy from unseen."""
    return dataset.filter(F.col("window_end_tick") + hops.horizon <= events.agg(F.max("tick")).scalar())


def build_training_set(
    enriched: DataFrame,
    util: DataFrame,
    fleet: DataFrame,
    hops: Hops | None = None,
    ticks_per_hour: int = TICKS_PER_HOUR,
) -> DataFrame:
    """20 count and utilisation features with label for every (node, window).

    Each source is reduced to its own (key, window) table first; the joins then only see those. Zone and rack tables
    are joined on (zone, window) and (rack, window).
    """
    hops = hops or Hops.hours(ticks_per_hour=ticks_per_hour)
    top = last_tick(enriched, util)
    kind, severity = F.col("kind"), F.col("severity")
    events = enriched.select("tick", "node_id", "rack_id", "zone_id", "kind", "severity")
    per_node = (
        to_windows(events.filter("node_id is not null"), hops, top)
        .groupBy("node_id", "window_end_tick")
        .agg(
            *[F.count_if(kind == k).alias(f"n_{k}") for k in KINDS],
            *[F.count_if(severity == s).alias(f"sev_{s}") for s in SEVERITIES],
            *[F.count_if(F.concat_ws("_", kind, severity) == p).alias(p) for p in PRECURSORS],
        )
    )
    hourly = util.groupBy(node_of_gpu(F.col("gpu_id")).alias("node_id"), "tick").agg(F.avg("util").alias("util"))
    load = (
        to_windows(hourly, hops, top)
        .groupBy("node_id", "window_end_tick")
        .agg(
            F.avg("util").alias("util_mean"), F.max("util").alias("util_max"), F.stddev_samp("util").alias("util_std")
        )
    )
    pressure = (
        to_windows(events.filter("zone_id is not null"), hops, top)
        .groupBy("zone_id", "window_end_tick")
        .agg(F.count("*").alias("zone_events_in_window"))
    )
    hot = (kind == "thermal_throttle") & severity.isin("warn", "critical") & F.col("rack_id").isNotNull()
    stress = (
        to_windows(events.filter(hot), hops, top)
        .groupBy("rack_id", "window_end_tick")
        .agg(F.count("*").alias("rack_thermal_stress"))
    )
    labels = window_labels(enriched, hops, top).select("node_id", "window_end_tick", F.lit(1).alias(LABEL))
    keys = ["node_id", "window_end_tick"]
    joined = (
        all_windows(fleet.select("node_id", "rack_id", "zone_id"), hops, top)
        .join(per_node, keys, "left")
        .join(load, keys, "left")
        .join(labels, keys, "left")
        .join(pressure, ["zone_id", "window_end_tick"], "left")
        .join(stress, ["rack_id", "window_end_tick"], "left")
        .withColumn("window_age_days", F.col("window_end_tick") / (ticks_per_hour * 24))
    )
    return _zero_filled(joined, (*V1_FEATURES, LABEL)).select(
        "node_id", "rack_id", "zone_id", *V1_FEATURES[:-1], LABEL, "window_end_tick", "window_age_days"
    )


def node_series(metrics: DataFrame) -> DataFrame:
    """Per (node, tick): mean level and summed counter increase over its GPUs."""
    return (
        counter_rates(metrics)
        .groupBy("node_id", "tick")
        .agg(
            *[F.avg(c).alias(c) for c in LEVELS],
            *[F.sum(c).cast("double").alias(c) for c in RATES],
        )
    )


def build_sequences(
    metrics: DataFrame, enriched: DataFrame, hops: Hops | None = None, samples: int = 64, min_samples: int = 4
) -> DataFrame:
    """Six arrays of ``samples`` evenly spaced values per (node, window), with the label.

    A window holds at most one row per tick of its look-back, which bounds the collected arrays.
    """
    hops = hops or Hops.hours()
    top = last_tick(metrics, enriched)
    windows = open_chunks(to_chunks(node_series(metrics), hops, top, "node_id"), hops)
    collected = (
        windows.groupBy("node_id", "_chunk", "window_end_tick")
        .agg(F.array_sort(F.collect_list(F.struct("tick", *SIGNALS))).alias("rows"))
        .withColumn("n", F.size("rows"))
        .filter(F.col("n") >= min_samples)
    )
    place = F.transform(
        F.sequence(F.lit(0), F.lit(samples - 1)),
        lambda s: F.rint(s * ((F.col("n") - 1) / max(samples - 1, 1))).cast("int") + 1,
    )
    picked = collected.withColumn("rows", F.transform(place, lambda p: F.element_at("rows", p)))
    labels = window_labels(enriched, hops, top).select("node_id", "window_end_tick", F.lit(1).alias(LABEL))
    return (
        picked.select("node_id", "window_end_tick", *[F.col(f"rows.{s}").alias(s) for s in SIGNALS])
        .join(labels, ["node_id", "window_end_tick"], "left")
        .withColumn(LABEL, F.coalesce(LABEL, F.lit(0)))
    )


def scale_sequences(sequences: DataFrame, train: Column) -> DataFrame:
    """Z-scores per channel, fitted on the training rows only and applied to all."""
    values = sequences.filter(train).select(F.explode(F.arrays_zip(*SIGNALS)).alias("v"))
    fit = values.agg(
        *[F.avg(f"v.{s}").alias(f"mean_{s}") for s in SIGNALS],
        *[F.stddev_pop(f"v.{s}").alias(f"std_{s}") for s in SIGNALS],
    )
    names = [f"{stat}_{s}" for stat in ("mean", "std") for s in SIGNALS]
    scaled = sequences.withColumn("_fit", fit.select(F.struct(*names)).scalar())

    def z(signal: str) -> Column:
        mean, std = F.col(f"_fit.mean_{signal}"), F.col(f"_fit.std_{signal}")
        return F.transform(signal, lambda v: (v - mean) / F.when(std > 1e-12, std).otherwise(1.0))

    return scaled.withColumns({s: z(s) for s in SIGNALS}).drop("_fit")


def feature_spread(dataset: DataFrame, columns: list[str], least: float = 1e-6) -> DataFrame:
    """Sample deviation of every feature and whether it exceeds the threshold, one row per feature."""
    row = dataset.agg(*[F.stddev_samp(c).alias(c) for c in columns])
    long = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("std")) for c in columns])
    return row.select(F.inline(long)).withColumn("kept", F.coalesce(F.col("std") > least, F.lit(False)))


def varying_columns(dataset: DataFrame, columns: list[str], least: float = 1e-6) -> list[str]:
    """Names of the features that vary: one aggregate, one row to the driver."""
    row = dataset.agg(*[F.stddev_samp(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] is not None and row[c] > least]
