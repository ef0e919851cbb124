"""SQL building blocks of the oracles: the adapters of :mod:`rackpulse.plans.adapters`, written independently."""

from __future__ import annotations

FLEET = """
fleet as (
  select distinct
    format('node-{:04d}', user_id) as node_id,
    format('rack-{:03d}', user_id // 5) as rack_id,
    'zone-' || (user_id // 100) as zone_id,
    'zone-' || (user_id // 100) || '/feed-' || (((user_id // 5) % 20) % 2) as feed_id,
    'spine-' || ((user_id // 5) % 2) as spine_id
  from events)"""

EVENTS = """
ev0 as (
  select *, date_diff('second', timestamp '2024-01-01', ts) as sec,
    format('node-{:04d}', user_id) as node, 'zone-' || (user_id // 100) as zone,
    cast(regexp_extract(props, '([0-9]+)', 1) as int) as k
  from events),
ev as (
  select event_id, sec // 300 as tick,
    case event_type when 'click' then 'thermal_throttle' when 'view' then 'nvlink_fault'
      when 'error' then 'ecc_uncorrectable' when 'purchase' then 'pcie_error'
      when 'signup' then 'cooling_failure' end as kind,
    case when event_type = 'signup' then 'zone' when event_type in ('click', 'error') then 'gpu' else 'node' end as scope,
    case when event_type = 'signup' then zone
      when event_type in ('click', 'error') then node || '/gpu' || (event_id % 8) else node end as target,
    case when value >= 100 then 'critical' when value >= 40 then 'warn' else 'info' end as severity,
    value < 40 as benign,
    case when (event_type = 'signup' and k < 50) or (event_type = 'click' and k < 10)
      then 'cooling-' || zone || '-' || (sec // 86400) end as parent_event_id
  from ev0)"""

ENRICHED = f"""{FLEET},{EVENTS},
enriched as (
  select ev.*, f.node_id, f.rack_id, case when scope = 'zone' then target else f.zone_id end as zone_id,
    f.feed_id, f.spine_id
  from ev left join fleet f on f.node_id = case when starts_with(target, 'node-') then split_part(target, '/', 1) end)"""

# The keep rule walked row by row along each (kind, target).
DEDUPED = f"""{ENRICHED},
numbered as (
  select *, row_number() over (partition by kind, target order by tick, event_id) as rn from enriched),
walk as (
  select kind, target, rn, tick as last_kept, true as keep from numbered where rn = 1
  union all
  select n.kind, n.target, n.rn,
    case when n.severity = 'critical' or n.tick - w.last_kept > 36 then n.tick else w.last_kept end,
    n.severity = 'critical' or n.tick - w.last_kept > 36
  from walk w join numbered n on n.kind = w.kind and n.target = w.target and n.rn = w.rn + 1),
deduped as (
  select n.* exclude (rn) from numbered n join walk w using (kind, target, rn) where w.keep)"""

INCIDENTS = f"""{DEDUPED},
keyed as (
  select *, case when parent_event_id is not null then 'cascade:' || parent_event_id
    else 'burst:' || kind || '|' || coalesce('rack_id=' || rack_id, 'zone_id=' || zone_id, 'feed_id=' || feed_id,
      'spine_id=' || spine_id, 'solo=' || target) || '|t' || (tick // 15) end as incident_id,
    case severity when 'critical' then 2 when 'warn' then 1 else 0 end as sev
  from deduped),
incidents as (
  select incident_id, min(tick) as opened_tick, max(tick) as resolved_tick, count(tick) as member_count,
    arg_min(kind, (tick, event_id)) as root_kind, arg_min(scope, (tick, event_id)) as scope,
    case max(sev) when 2 then 'critical' when 1 then 'warn' else 'info' end as severity_max,
    bool_and(benign) as all_benign, bool_or(benign) as any_benign, max(tick) - min(tick) as duration_ticks
  from keyed group by incident_id)"""

UTIL = """
util as (
  select 12 * date_diff('day', timestamp '1995-01-01', l_shipdate) as tick,
    format('node-{:04d}', l_suppkey) || '/gpu' || (l_linenumber % 8) as gpu_id,
    sum(l_quantity - 1) / count(*) / 49 as util
  from lineitem group by all)"""

METRICS = """
mt0 as (
  select date_diff('second', timestamp '2024-01-01', ts) // 300 as tick,
    format('node-{:04d}', user_id) || '/gpu' || (event_id % 2) as gpu_id, value, event_type,
    cast(regexp_extract(props, '([0-9]+)', 1) as int) as k
  from events),
mt1 as (
  select gpu_id, tick, max(value) as gpu_temp_c, max(k) as k, count(*) filter (event_type = 'error') as n_err,
    count(*) filter (event_type = 'view') as n_view, count(*) filter (event_type = 'purchase') as n_buy
  from mt0 group by gpu_id, tick),
metrics as (
  select tick, gpu_id, split_part(gpu_id, '/', 1) as node_id, gpu_temp_c,
    210.0::double + 4.9::double * k as gpu_power_w, k / 100 as gpu_sm_util,
    cast(sum(n_err) over so_far as bigint) as ecc_corrected_total,
    cast(sum(n_view) over so_far as bigint) as nvlink_crc_total,
    cast(sum(n_buy) over so_far as bigint) as pcie_aer_total
  from mt1 window so_far as (partition by gpu_id order by tick))"""

TICKETS = """
tickets as (
  select o_orderkey as ticket_id, o_orderpriority as priority,
    o_orderdate - to_hours(cast(o_orderkey % 24 as int)) as event_at, o_orderdate as opened_at, resolved_at,
    o_orderstatus = 'P' as reopened
  from orders left join (select l_orderkey, max(l_shipdate) as resolved_at from lineitem group by 1) s
    on s.l_orderkey = o_orderkey)"""


def sql(ctes: str, body: str) -> str:
    """A query over shared CTEs; recursion is only used by the dedupe walk."""
    return f"with recursive {ctes.strip()}\n{body.strip()}"
