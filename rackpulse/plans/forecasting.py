"""Queries of the capacity forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.operators import energy, forecast as G
from rackpulse.plans import adapters as A
from rackpulse.plans.ctes import FLEET, INCIDENTS, UTIL, sql
from rackpulse.plans import kpi as K

HORIZON = 48
WEEKS = 28 * 24


def _rounded(df: DataFrame) -> DataFrame:
    return K.rounded(df, 6, "yhat", "yhat_lower", "yhat_upper")


def fleet_series(spark: SparkSession, sf: str) -> DataFrame:
    return energy.hourly_gpu_hours(A.utilization(spark, sf))


def node_series(spark: SparkSession, sf: str) -> DataFrame:
    util = A.utilization(spark, sf).withColumn("node_id", F.substring_index("gpu_id", "/", 1))
    return energy.hourly_gpu_hours(util, "node_id")


def forecast_fleet(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(G.forecast(fleet_series(spark, sf), HORIZON))


def forecast_by_node(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(G.forecast(node_series(spark, sf), HORIZON, by=("node_id",)))


def short_series_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Orders per priority and year: series too short to decompose take the flat path."""
    monthly = A.table(spark, sf, "orders").groupBy(
        F.col("o_orderpriority").alias("series"), F.expr("cast(year(o_orderdate) as bigint)").alias("tick")
    ).agg(F.count("*").cast("double").alias("value"))
    return _rounded(G.forecast(monthly, 3, by=("series",)))


def threshold_crossing(spark: SparkSession, sf: str) -> DataFrame:
    """Per node: ticks and weeks until the forecast reaches 70 % of eight GPUs scaled to the sample density."""
    predicted = G.forecast(node_series(spark, sf), WEEKS, by=("node_id",))
    crossing = G.threshold_crossing(predicted, 0.9, 0.7, by=("node_id",))
    return crossing.withColumn("weeks", G.weeks_of(F.col("ticks_to_threshold")))


def headroom(spark: SparkSession, sf: str) -> DataFrame:
    """Headroom of every tick against the fleet's GPU capacity."""
    capacity = A.fleet(spark, sf).agg(F.countDistinct("node_id") * 8).scalar()
    series = fleet_series(spark, sf)
    return K.rounded(series.select("tick", G.headroom(F.col("value"), capacity).alias("headroom")), 6, "headroom")


def observed_and_forecast(spark: SparkSession, sf: str) -> DataFrame:
    series = fleet_series(spark, sf)
    return K.rounded(G.observed_and_forecast(series, G.forecast(series, HORIZON)), 6, "observed", "forecast")


QUERIES = {
    "forecast_fleet": forecast_fleet,
    "forecast_by_node": forecast_by_node,
    "short_series_forecast": short_series_forecast,
    "threshold_crossing": threshold_crossing,
    "headroom": headroom,
    "observed_and_forecast": observed_and_forecast,
}


def _forecast_ctes(source: str, horizon: int) -> str:
    """Forecast of a relation (key, tick, value) as CTE ``fc``."""
    return f"""
pts as (select *, (tick // 12) % 24 as hod, tick // 288 as day from ({source})),
daily as (select key, day, avg(value) as m from pts group by key, day),
line as (
  select key, case when count(*) > 1 then regr_slope(m, day) else 0 end / 288 as slope,
    case when count(*) > 1 then regr_intercept(m, day) else avg(m) end as intercept from daily group by key),
res as (select p.*, value - (slope * tick + intercept) as r from pts p join line using (key)),
cyc as (select key, hod, avg(r) as level from res group by key, hod),
sig as (select key, stddev_pop(r - level) as sigma from res join cyc using (key, hod) group by key),
siz as (select key, count(*) as n, max(tick) as last_tick, avg(value) as mean, stddev_samp(value) as sd from pts group by key),
steps as (select unnest(generate_series(1, {horizon})) as i),
fut as (select *, last_tick + i * case when n >= 24 then 12 else 1 end as t from siz, steps),
fc0 as (
  select f.key, f.t as tick, n, sigma, case when n >= 24 then greatest(0, slope * f.t + intercept + coalesce(level, 0))
    else mean end as yhat, case when n > 1 then sd else mean * 0.1 end as sd
  from fut f join line using (key) join sig using (key) left join cyc c on c.key = f.key and c.hod = (f.t // 12) % 24),
fc as (
  select key, tick, yhat,
    case when n >= 24 then greatest(0, yhat - 1.28::double * sigma) else yhat - 1.28::double * sd end as yhat_lower,
    case when n >= 24 then yhat + 1.28::double * sigma else yhat + 1.28::double * sd end as yhat_upper
  from fc0)"""


_FLEET = "select 'all' as key, tick, sum(util) as value from util group by tick"
_NODES = "select split_part(gpu_id, '/', 1) as key, tick, sum(util) as value from util group by 1, 2"
_OUT = "tick, round(yhat, 6) as yhat, round(yhat_lower, 6) as yhat_lower, round(yhat_upper, 6) as yhat_upper"

ORACLES = {
    "forecast_fleet": sql(f"{UTIL},{_forecast_ctes(_FLEET, HORIZON)}", f"select {_OUT} from fc"),
    "forecast_by_node": sql(f"{UTIL},{_forecast_ctes(_NODES, HORIZON)}", f"select key as node_id, {_OUT} from fc"),
    "short_series_forecast": sql(
        _forecast_ctes(
            "select o_orderpriority as key, year(o_orderdate) as tick, count(*)::double as value from orders group by 1, 2", 3
        ),
        f"select key as series, {_OUT} from fc",
    ),
    "threshold_crossing": sql(
        f"{UTIL},{_forecast_ctes(_NODES, WEEKS)}",
        """, x as (select key, min(tick) filter (yhat >= 0.7::double * 0.9::double) - min(tick) as t from fc group by key)
select key as node_id, t as ticks_to_threshold, round_even(t / 168, 2) as weeks from x""",
    ),
    "headroom": sql(
        f"{UTIL},{FLEET}",
        "select tick, round(greatest(0, 1 - sum(util) / (select count(*) * 8 from fleet)), 6) as headroom from util group by tick",
    ),
    "observed_and_forecast": sql(
        f"{UTIL},{_forecast_ctes(_FLEET, HORIZON)}",
        """, o as (select tick, sum(util) as value from util group by tick)
select coalesce(o.tick, fc.tick) as tick, round(value, 6) as observed, round(yhat, 6) as forecast
from o full join fc on o.tick = fc.tick""",
    ),
    "weekly_kpi_row": sql(
        f"{INCIDENTS},{K._ENERGY},{_forecast_ctes(_FLEET, WEEKS)}",
        """, h as (select tick, sum(util) as v from util group by tick),
cap as (select count(distinct node_id) * 8 as capacity from fleet),
x as (select min(tick) filter (yhat >= 0.01::double * capacity) - min(tick) as t from fc, cap),
i as (select count(*) as n, count(*) filter (severity_max = 'critical') as critical from incidents),
r as (select count(*) as raw, count(*) filter (benign) as benign from ev)
select raw as raw_events, n as incidents, round(raw / n, 4) as compression, critical, round(benign / raw, 4) as noise_rate,
  capacity, round(greatest(0, 1 - (select avg(v) from h) / capacity), 4) as headroom,
  round(round_even(t / 168, 2), 4) as weeks_to_threshold, 672 as horizon_hours, round(avg_fleet_kw, 4) as avg_kw,
  round(total_kwh, 4) as total_kwh, round(idle_kwh, 4) as idle_kwh, round(idle_kwh * 0.06::double, 4) as idle_dollars,
  round(total_gpu_hours * 1000 / (total_kwh * 1000), 8) as perf_w
from r, i, cap, x, energy""",
    ),
}
