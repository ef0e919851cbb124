"""Streaming queries over the test tables, run to the end of the input.

Append mode emits what the watermark has closed; the oracles apply the same cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.plans import adapters as A
from rackpulse.plans.ctes import DEDUPED, ENRICHED, METRICS, sql
from rackpulse.plans.ingest import EPOCH, listing_lines, matrix_payloads
from rackpulse.plans.ingest import ORACLES as INGEST_ORACLES
from rackpulse.plans.kpi import rounded
from rackpulse.session import work_path
from rackpulse.streaming import alerts, telemetry
from rackpulse.streaming.run import drain


def raw_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = A.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    return A.as_events(raw_stream(spark, sf)).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return drain(alerts.dedupe_stream(event_stream(spark, sf), A.DEDUPE_WINDOW), "dedupe")


def stream_bursts(spark: SparkSession, sf: str) -> DataFrame:
    bursts = alerts.burst_stream(event_stream(spark, sf), A.fleet(spark, sf), A.BURST_WINDOW, EPOCH)
    return drain(bursts, "bursts")


def stream_window_stats(spark: SparkSession, sf: str) -> DataFrame:
    samples = raw_stream(spark, sf).select(
        F.col("ts").cast("timestamp").alias("ts"), F.format_string("node-%04d", "user_id").alias("node_id"), "value"
    )
    stats = drain(alerts.window_stats_stream(samples, "node_id", "value", 240, 60, EPOCH), "hopping")
    return rounded(stats, 9, "mean", "std", "min", "max")


def stream_listing(spark: SparkSession, sf: str) -> DataFrame:
    path = work_path(spark, "listing-landing")
    listing_lines(A.metrics(spark, sf)).write.text(path)
    return rounded(drain(telemetry.listing_stream(spark, path), "listing"), 6, "gpu_temp_c", "gpu_power_w", "gpu_sm_util")


def stream_matrix(spark: SparkSession, sf: str) -> DataFrame:
    path = work_path(spark, "matrix-landing")
    matrix_payloads(A.metrics(spark, sf)).write.text(path)
    wide = drain(telemetry.range_query_stream(spark, path, EPOCH, "0 seconds"), "matrix")
    return rounded(wide, 6, "gpu_temp_c", "gpu_power_w", "gpu_sm_util")


QUERIES = {
    "stream_dedupe": stream_dedupe,
    "stream_bursts": stream_bursts,
    "stream_window_stats": stream_window_stats,
    "stream_listing": stream_listing,
    "stream_matrix": stream_matrix,
}

# Ten minutes behind the last event, to the millisecond as the watermark is kept.
_MARK = "(select date_trunc('milliseconds', max(ts)) - interval 10 minutes from events)"

ORACLES = {
    "stream_dedupe": sql(
        DEDUPED,
        f"""select event_id, tick, kind, scope, target, severity, benign, parent_event_id from deduped
where severity = 'critical' or timestamp '2024-01-01' + to_seconds((tick + 1) * 300) <= {_MARK}""",
    ),
    "stream_bursts": sql(
        ENRICHED,
        f"""select 'burst:' || kind || '|' || coalesce('rack_id=' || rack_id, 'zone_id=' || zone_id, 'feed_id=' || feed_id,
    'spine_id=' || spine_id, 'solo=' || target) || '|t' || (tick // 15) as incident_id, count(*) as member_count,
  min(tick) as opened_tick, max(tick) as resolved_tick, bool_and(benign) as all_benign
from enriched where parent_event_id is null and timestamp '2024-01-01' + to_seconds((tick // 15 + 1) * 4500) <= {_MARK}
group by 1""",
    ),
    "stream_window_stats": f"""
with ends as (select unnest(generate_series(1, 20)) as k),
w as (select timestamp '2024-01-01' + to_hours(cast(60 * k as int)) as e, k * 720 as window_end_tick from ends)
select format('node-{{:04d}}', user_id) as node_id, window_end_tick, count(*) as n, round(avg(value), 9) as mean,
  round(stddev_pop(value), 9) as std, round(min(value), 9) as min, round(max(value), 9) as max
from events join w on ts < e and ts >= e - interval 240 hours
where e <= {_MARK} group by 1, 2""",
    "stream_listing": INGEST_ORACLES["dmon_rows"],
    "stream_matrix": sql(
        METRICS,
        """select tick, gpu_id, node_id, null::varchar as rack_id, null::varchar as zone_id, round(gpu_temp_c, 6) as gpu_temp_c,
  round(gpu_power_w, 6) as gpu_power_w, round(gpu_sm_util, 6) as gpu_sm_util, ecc_corrected_total, nvlink_crc_total, pcie_aer_total
from metrics""",
    ),
}
