"""Queries of the sliding-window features, labels, data sets and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.functions.windows import Hops, last_tick
from rackpulse.operators import window_features as WF
from rackpulse.plans import adapters as A
from rackpulse.plans.correlation import enriched_of
from rackpulse.plans.ctes import ENRICHED, METRICS, UTIL, sql
from rackpulse.plans.kpi import rounded
from rackpulse.schemas import KINDS, RATES, SEVERITIES, SIGNALS, STATS

# The test events are sparse, so windows are longer than the defaults.
HOPS = Hops.hours(lookback=240, horizon=120, step=60)


def dataset_v2(spark: SparkSession, sf: str) -> DataFrame:
    return WF.build_timeseries_dataset(A.metrics(spark, sf), enriched_of(spark, sf), A.fleet(spark, sf), HOPS)


def dataset_v1(spark: SparkSession, sf: str) -> DataFrame:
    return WF.build_training_set(enriched_of(spark, sf), A.utilization(spark, sf), A.fleet(spark, sf), HOPS)


def _long_stats(spark: SparkSession, sf: str, *stats: str) -> DataFrame:
    """GPU window statistics with one row per signal."""
    wide = WF.gpu_window_stats(A.metrics(spark, sf), HOPS)
    rows = [
        F.struct(F.lit(s).alias("signal"), *[F.round(F.col(f"{s}__{stat}"), 6).alias(stat) for stat in stats])
        for s in SIGNALS
    ]
    return wide.select("gpu_id", "window_end_tick", F.inline(F.array(*rows)))


def node_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(WF.node_window_stats(A.metrics(spark, sf), HOPS), 6, *WF.SIGNAL_FEATURES)


def counter_rates(spark: SparkSession, sf: str) -> DataFrame:
    return WF.counter_rates(A.metrics(spark, sf)).select("gpu_id", "tick", *RATES)


def precursor_counts(spark: SparkSession, sf: str) -> DataFrame:
    enriched = enriched_of(spark, sf)
    return WF.precursor_counts(enriched, HOPS, last_tick(enriched))


def window_labels(spark: SparkSession, sf: str) -> DataFrame:
    enriched = enriched_of(spark, sf)
    return WF.window_labels(enriched, HOPS, last_tick(enriched))


def training_set_v1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(dataset_v1(spark, sf), 6, "util_mean", "util_max", "util_std", "window_age_days")


def training_set_v2(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(dataset_v2(spark, sf), 6, *WF.SIGNAL_FEATURES).drop("first_event_tick")


def _exploded(sequences: DataFrame) -> DataFrame:
    flat = sequences.select(
        "node_id", "window_end_tick", WF.LABEL, F.posexplode(F.arrays_zip(*SIGNALS)).alias("pos", "v")
    )
    return flat.select("node_id", "window_end_tick", WF.LABEL, "pos", *[F.round(f"v.{s}", 6).alias(s) for s in SIGNALS])


def sequences_of(spark: SparkSession, sf: str) -> DataFrame:
    return WF.build_sequences(A.metrics(spark, sf), enriched_of(spark, sf), HOPS)


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    return _exploded(sequences_of(spark, sf))


def sequence_scaling(spark: SparkSession, sf: str) -> DataFrame:
    """Channel scaling fitted on the windows that end before tick 5000."""
    return _exploded(WF.scale_sequences(sequences_of(spark, sf), F.col("window_end_tick") < 5000))


def feature_spread(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(WF.feature_spread(dataset_v1(spark, sf), list(WF.V1_FEATURES)), 6, "std")


QUERIES = {
    "counter_rates": counter_rates,
    "window_stats": lambda spark, sf: _long_stats(spark, sf, "mean", "std", "min", "max", "range", "last"),
    "window_autocorr": lambda spark, sf: _long_stats(spark, sf, "ac1"),
    "window_slope": lambda spark, sf: _long_stats(spark, sf, "slope"),
    "window_spikes": lambda spark, sf: _long_stats(spark, sf, "spike_count"),
    "window_volatility": lambda spark, sf: _long_stats(spark, sf, "vol_max"),
    "node_rollup": node_rollup,
    "precursor_counts": precursor_counts,
    "window_labels": window_labels,
    "training_set_v1": training_set_v1,
    "training_set_v2": training_set_v2,
    "sequences": sequences,
    "sequence_scaling": sequence_scaling,
    "feature_spread": feature_spread,
}

LB, H, ST = HOPS.lookback, HOPS.horizon, HOPS.step

_RATED = f"""{METRICS},
rates as (
  select gpu_id, node_id, tick, gpu_temp_c, gpu_power_w, gpu_sm_util,
    coalesce(greatest(ecc_corrected_total - lag(ecc_corrected_total) over s, 0), 0) as ecc_corrected_rate,
    coalesce(greatest(nvlink_crc_total - lag(nvlink_crc_total) over s, 0), 0) as nvlink_crc_rate,
    coalesce(greatest(pcie_aer_total - lag(pcie_aer_total) over s, 0), 0) as pcie_aer_rate
  from metrics window s as (partition by gpu_id order by tick))"""


def _ends(top: str) -> str:
    return f"ends as (select unnest(generate_series({LB}, {top} - {H}, {ST})) as e)"


def _stats(top: str) -> str:
    """Long statistics per (gpu, window, signal) by a range join of samples and windows."""
    return f"""{METRICS},
{_ends(top)},
inwin as (
  select m.*, e, row_number() over w as i, count(*) over (partition by gpu_id, e) as n,
    coalesce(greatest(ecc_corrected_total - lag(ecc_corrected_total) over w, 0), 0) as r_ecc,
    coalesce(greatest(nvlink_crc_total - lag(nvlink_crc_total) over w, 0), 0) as r_nvl,
    coalesce(greatest(pcie_aer_total - lag(pcie_aer_total) over w, 0), 0) as r_pci
  from metrics m join ends on m.tick >= e - {LB} and m.tick < e
  window w as (partition by gpu_id, e order by tick)),
samples as (
  select gpu_id, e, i, n, greatest(3, n // 6) as w, unnest(['gpu_temp_c', 'gpu_power_w', 'gpu_sm_util', 'ecc_corrected_rate',
      'nvlink_crc_rate', 'pcie_aer_rate']) as signal,
    unnest([gpu_temp_c, gpu_power_w, gpu_sm_util, r_ecc::double, r_nvl::double, r_pci::double]) as v
  from inwin),
lagged as (select *, lag(v) over (partition by gpu_id, e, signal order by i) as p from samples),
base as (
  select gpu_id, e, signal, max(n) as n, avg(v) as mean, stddev_pop(v) as std, min(v) as min, max(v) as max,
    coalesce(regr_slope(v, i), 0) as slope, max(v) filter (i = n) as last,
    coalesce(covar_pop(p, v) * count(p) / (sqrt(var_pop(v) filter (p is not null) * count(p))
      * sqrt(var_pop(p) * count(p)) + 1e-12::double), 0) as ac1
  from lagged group by all),
rolls as (
  select a.gpu_id, a.e, a.signal, a.i, stddev_samp(b.v) as s
  from samples a join samples b on a.gpu_id = b.gpu_id and a.e = b.e and a.signal = b.signal and b.i between a.i - a.w + 1 and a.i
  where a.i >= a.w and a.n >= 6 group by all),
vol as (select gpu_id, e, signal, max(s) as vol from rolls group by all),
spikes as (
  select s.gpu_id, s.e, s.signal, count(*) filter (v > mean + 2 * std + 1e-9::double)::double as spike_count
  from samples s join base b on b.gpu_id = s.gpu_id and b.e = s.e and b.signal = s.signal group by all),
stats as (
  select gpu_id, e as window_end_tick, signal, round(mean, 6) + 0 as mean, round(std, 6) as std, round(min, 6) as min, round(max, 6) as max,
    round(max - min, 6) as "range", round(slope, 6) + 0 as slope, round(ac1, 6) + 0 as ac1, spike_count, round(last, 6) as last,
    round(case when n >= 6 then vol else std end, 6) as vol_max
  from base left join vol using (gpu_id, e, signal) join spikes using (gpu_id, e, signal))"""


_METRIC_TOP = "(select max(tick) from metrics)"
_BOTH_TOP = "(select greatest(max(tick), (select max(tick) from ev)) from metrics)"
_ROLLUP_COLS = ",\n  ".join(
    f"max(\"{stat}\") filter (signal = '{s}') as {s}__{stat}" for s in SIGNALS for stat in STATS
)
_EV_COUNTS = ", ".join(
    f"count(*) filter (kind = '{k}' and severity = '{s}') as ev_{k}_{s}"
    for k in ("ecc_uncorrectable", "nvlink_fault", "pcie_error", "thermal_throttle")
    for s in SEVERITIES
)
_COMPONENT = "severity = 'critical' and kind in ('ecc_uncorrectable', 'nvlink_fault', 'pcie_error')"
_AHEAD = f"tick >= e and tick < e + {H} and {_COMPONENT} and node_id is not null"
_BACK = f"tick >= e - {LB} and tick < e"


def _events_in(top: str) -> str:
    return f"""{ENRICHED},
{_ends(top)}"""


_EV_TOP = "(select max(tick) from ev)"

_V1 = f"""{ENRICHED},{UTIL},
{_ends("(select greatest(max(tick), (select max(tick) from util)) from ev)")},
pn as (
  select node_id, e, {", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in KINDS)},
    {", ".join(f"count(*) filter (severity = '{s}') as sev_{s}" for s in SEVERITIES)},
    count(*) filter (kind = 'ecc_uncorrectable' and severity = 'info') as ecc_uncorrectable_info,
    count(*) filter (kind = 'nvlink_fault' and severity = 'warn') as nvlink_fault_warn,
    count(*) filter (kind = 'pcie_error' and severity = 'warn') as pcie_error_warn
  from enriched join ends on {_BACK} where node_id is not null group by all),
uh as (select split_part(gpu_id, '/', 1) as node_id, tick, avg(util) as util from util group by 1, 2),
un as (
  select node_id, e, avg(util) as util_mean, max(util) as util_max, stddev_samp(util) as util_std
  from uh join ends on {_BACK} group by all),
zp as (select zone_id, e, count(*) as zone_events_in_window from enriched join ends on {_BACK} where zone_id is not null group by all),
rs as (
  select rack_id, e, count(*) as rack_thermal_stress from enriched join ends on {_BACK}
  where kind = 'thermal_throttle' and severity <> 'info' and rack_id is not null group by all),
lb as (select distinct node_id, e from enriched join ends on {_AHEAD}),
v1 as (
  select f.node_id, f.rack_id, f.zone_id,
    {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in KINDS)}, {", ".join(f"coalesce(sev_{s}, 0) as sev_{s}" for s in SEVERITIES)},
    {", ".join(f"coalesce({p}, 0) as {p}" for p in WF.PRECURSORS)},
    round(coalesce(util_mean, 0), 6) as util_mean, round(coalesce(util_max, 0), 6) as util_max, round(coalesce(util_std, 0), 6) as util_std,
    coalesce(zone_events_in_window, 0) as zone_events_in_window, coalesce(rack_thermal_stress, 0) as rack_thermal_stress,
    case when lb.e is null then 0 else 1 end as failed_next_24h, ends.e as window_end_tick, round(ends.e / 288, 6) as window_age_days
  from fleet f cross join ends left join pn on pn.node_id = f.node_id and pn.e = ends.e left join un on un.node_id = f.node_id and un.e = ends.e
    left join zp on zp.zone_id = f.zone_id and zp.e = ends.e left join rs on rs.rack_id = f.rack_id and rs.e = ends.e
    left join lb on lb.node_id = f.node_id and lb.e = ends.e)"""

_SEQ = f"""{_RATED},{ENRICHED},
{_ends(_BOTH_TOP)},
ns as (
  select node_id, tick, avg(gpu_temp_c) as gpu_temp_c, avg(gpu_power_w) as gpu_power_w, avg(gpu_sm_util) as gpu_sm_util,
    sum(ecc_corrected_rate)::double as ecc_corrected_rate, sum(nvlink_crc_rate)::double as nvlink_crc_rate,
    sum(pcie_aer_rate)::double as pcie_aer_rate from rates group by node_id, tick),
nw as (
  select ns.*, e, row_number() over (partition by node_id, e order by tick) - 1 as i, count(*) over (partition by node_id, e) as n
  from ns join ends on {_BACK}),
pick as (
  select node_id, e, s, cast(round_even(s * ((n - 1) / 63), 0) as bigint) as i
  from (select distinct node_id, e, n from nw where n >= 4), (select unnest(generate_series(0, 63)) as s)),
lb as (select distinct node_id, e from enriched join ends on {_AHEAD}),
seq as (
  select node_id, e as window_end_tick, case when lb.e is null then 0 else 1 end as failed_next_24h, s as pos, {", ".join(SIGNALS)}
  from pick join nw using (node_id, e, i) left join lb using (node_id, e))"""

ORACLES = {
    "counter_rates": sql(_RATED, f"select gpu_id, tick, {', '.join(RATES)} from rates"),
    **{
        name: sql(_stats(_METRIC_TOP), f"select gpu_id, window_end_tick, signal, {columns} from stats")
        for name, columns in {
            "window_stats": 'mean, std, min, max, "range", last',
            "window_autocorr": "ac1",
            "window_slope": "slope",
            "window_spikes": "spike_count",
            "window_volatility": "vol_max",
        }.items()
    },
    "node_rollup": sql(
        _stats(_METRIC_TOP),
        f"select split_part(gpu_id, '/', 1) as node_id, window_end_tick, {_ROLLUP_COLS} from stats group by 1, 2",
    ),
    "precursor_counts": sql(
        _events_in(_EV_TOP),
        f"""select node_id, e as window_end_tick, {_EV_COUNTS} from enriched join ends on {_BACK}
where node_id is not null and kind in ('ecc_uncorrectable', 'nvlink_fault', 'pcie_error', 'thermal_throttle') group by 1, 2""",
    ),
    "window_labels": sql(
        _events_in(_EV_TOP),
        f"select node_id, e as window_end_tick, count(*) as critical_events, min(tick) as first_event_tick"
        f" from enriched join ends on {_AHEAD} group by 1, 2",
    ),
    "training_set_v1": sql(_V1, "select * from v1"),
    "training_set_v2": sql(
        f"{ENRICHED},{_stats(_BOTH_TOP)}",
        f""", r as (
  select split_part(gpu_id, '/', 1) as node_id, window_end_tick as e, {_ROLLUP_COLS} from stats group by 1, 2),
c as (select node_id, e, {_EV_COUNTS} from enriched join ends on {_BACK} where node_id is not null group by 1, 2),
lb as (select distinct node_id, e from enriched join ends on {_AHEAD})
select r.node_id, r.e as window_end_tick, r.* exclude (node_id, e),
  {", ".join(f"coalesce({x}, 0) as {x}" for x in WF.EVENT_FEATURES)},
  case when lb.e is null then 0 else 1 end as failed_next_24h, f.rack_id, f.zone_id
from r left join c on c.node_id = r.node_id and c.e = r.e left join lb on lb.node_id = r.node_id and lb.e = r.e
  left join fleet f on f.node_id = r.node_id""",
    ),
    "sequences": sql(
        _SEQ,
        "select node_id, window_end_tick, failed_next_24h, pos, "
        + ", ".join(f"round({s}, 6) as {s}" for s in SIGNALS) + " from seq",
    ),
    "sequence_scaling": sql(
        _SEQ,
        ", sq as materialized (select * from seq), f as (select " + ", ".join(f"avg({s}) as m_{s}, stddev_pop({s}) as d_{s}" for s in SIGNALS)
        + " from sq where window_end_tick < 5000)\nselect node_id, window_end_tick, failed_next_24h, pos, "
        + ", ".join(f"round(({s} - m_{s}) / case when d_{s} > 1e-12 then d_{s} else 1 end, 6) + 0 as {s}" for s in SIGNALS)
        + " from sq, f",
    ),
    "feature_spread": sql(
        _V1,
        "\nunion all ".join(
            f"select '{c}' as feature, round(stddev_samp({c}), 6) as std, stddev_samp({c}) > 1e-6 as kept from v1"
            for c in WF.V1_FEATURES
        ),
    ),
}
