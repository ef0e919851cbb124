"""Queries of incident features, families and their quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.functions.scaling import standardise, standardise_vectors
from rackpulse.operators import clustering, families
from rackpulse.operators.incident_features import FEATURES, featurize
from rackpulse.plans import adapters as A
from rackpulse.plans.correlation import incidents_of
from rackpulse.plans.ctes import INCIDENTS, sql
from rackpulse.schemas import KINDS, SCOPES
from rackpulse.session import materialise

MIN_SIZE = 8
EPS = 0.5


def _rounded(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def stored_incidents(spark: SparkSession, sf: str) -> DataFrame:
    """Incidents written once: the clustering reads them several times."""
    return materialise(incidents_of(spark, sf), "incidents")


def clustered_of(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.cluster_incidents(stored_incidents(spark, sf), MIN_SIZE, EPS)


def incident_features(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(featurize(incidents_of(spark, sf)), FEATURES)


def standardised_features(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(standardise(featurize(incidents_of(spark, sf)), FEATURES), FEATURES)


def standardised_vectors(spark: SparkSession, sf: str) -> DataFrame:
    vectors = standardise_vectors(
        A.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")),
        "embedding",
    )
    return vectors.select("vec_id", F.posexplode("embedding").alias("pos", "z")).withColumn("z", F.round("z", 5))


def density_families(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.density_clusters(stored_incidents(spark, sf), MIN_SIZE, EPS).select("incident_id", "cluster_id")


def family_labels(spark: SparkSession, sf: str) -> DataFrame:
    return clustered_of(spark, sf).select("cluster_id", "cluster_label").distinct()


def top_families(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(families.top_recurring(clustered_of(spark, sf), 10), ("all_benign_ratio", "mean_members"))


def family_counts(spark: SparkSession, sf: str) -> DataFrame:
    clustered = clustering.density_clusters(stored_incidents(spark, sf), MIN_SIZE, EPS)
    return families.cluster_counts(clustered)


def kmeans_families(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.kmeans_clusters(stored_incidents(spark, sf))


def silhouette(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of a given grouping, here the one by kind and severity."""
    incidents = stored_incidents(spark, sf)
    groups = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i * 3))])
    grouping = groups[F.col("root_kind")] + F.when(F.col("severity_max") == "critical", 2).when(
        F.col("severity_max") == "warn", 1
    ).otherwise(0)
    return _rounded(clustering.silhouette(incidents, grouping), ("silhouette",))


QUERIES = {
    "incident_features": incident_features,
    "standardised_features": standardised_features,
    "standardised_vectors": standardised_vectors,
    "density_families": density_families,
    "family_labels": family_labels,
    "top_families": top_families,
    "family_counts": family_counts,
    "kmeans_families": kmeans_families,
    "silhouette": silhouette,
}

_HOT = ",\n    ".join(
    [f"cast(root_kind = '{k}' as int)::double as kind_{k}" for k in KINDS]
    + [f"cast(scope = '{s}' as int)::double as scope_{s}" for s in SCOPES]
)
_FEATURES = f"""{INCIDENTS},
feat as (
  select incident_id, {_HOT},
    ln(1 + member_count) as log_member_count, duration_ticks::double as duration_ticks,
    case severity_max when 'critical' then 2.0 when 'warn' then 1.0 else 0.0 end::double as severity,
    sin(2 * pi() * ((opened_tick // 12) % 24) / 24) as hod_sin, cos(2 * pi() * ((opened_tick // 12) % 24) / 24) as hod_cos,
    all_benign::int::double as all_benign
  from incidents)"""

FAMILIES = f"""{INCIDENTS},
lat0 as (
  select *, case severity_max when 'critical' then 2 when 'warn' then 1 else 0 end as rank,
    (opened_tick // 12) % 24 as hod, cast(round(ln(1 + member_count) * 4) as bigint) as size_step
  from incidents),
dev as (
  select stddev_pop(ln(1 + member_count)) as s_size, stddev_pop(duration_ticks) as s_time,
    stddev_pop(sin(2 * pi() * hod / 24)) as s_sin, stddev_pop(cos(2 * pi() * hod / 24)) as s_cos from lat0),
lat as (
  select root_kind || '|' || scope || '|' || rank || '|' || all_benign || '|' || hod || '|' || size_step || '|'
      || duration_ticks as id, root_kind, scope, rank, all_benign, hod, size_step, duration_ticks, count(*) as weight
  from lat0 group by all),
near as (
  select a.id as src, b.id as dst, b.weight
  from lat a join lat b on a.root_kind = b.root_kind and a.scope = b.scope and a.rank = b.rank
    and a.all_benign = b.all_benign, dev
  where ((sin(2 * pi() * a.hod / 24) - sin(2 * pi() * b.hod / 24)) / s_sin) ** 2
    + ((cos(2 * pi() * a.hod / 24) - cos(2 * pi() * b.hod / 24)) / s_cos) ** 2
    + ((a.size_step - b.size_step) / 4 / s_size) ** 2
    + ((a.duration_ticks - b.duration_ticks) / s_time) ** 2 <= 0.25),
core as (select src as id from near group by src having sum(weight) >= 8),
links as (select src, dst from near where src in (select id from core) and dst in (select id from core)),
reach as (
  select id, id as label from core
  union
  select l.dst, r.label from reach r join links l on l.src = r.id),
comp as (select id, min(label) as label from reach group by id),
fam as (
  select label, row_number() over (order by label) - 1 as cluster_id from comp join lat using (id)
  group by label having sum(weight) >= 8),
clustered as (
  select i.*, coalesce(f.cluster_id, -1) as cluster_id
  from lat0 i join lat l using (root_kind, scope, rank, all_benign, hod, size_step, duration_ticks)
    left join comp c on c.id = l.id left join fam f on f.label = c.label),
modes as (
  select cluster_id, 'root_kind' as part, root_kind as v, count(*) as n from clustered group by all
  union all select cluster_id, 'scope', scope, count(*) from clustered group by all
  union all select cluster_id, 'severity', severity_max, count(*) from clustered group by all
  union all select cluster_id, 'hour', format('{{:02d}}', hod), count(*) from clustered group by all),
best as (
  select cluster_id, part, v from modes
  qualify row_number() over (partition by cluster_id, part order by n desc, v) = 1),
names as (
  select cluster_id, case when cluster_id = -1 then 'noise / unclustered' else
    max(v) filter (part = 'root_kind') || ' · ' || max(v) filter (part = 'scope') || ' · '
    || max(v) filter (part = 'severity') || ' · ~' || max(v) filter (part = 'hour') || ':00 ('
    || (select count(*) from clustered c where c.cluster_id = best.cluster_id) || '×)' end as cluster_label
  from best group by cluster_id)"""

_ROUNDED = ", ".join(f"round({c}, 6) + 0 as {c}" for c in FEATURES)
_SCALED = ", ".join(
    f"round(({c} - (select avg({c}) from feat)) / (select case when stddev_pop({c}) > 1e-12 then stddev_pop({c})"
    f" else 1 end from feat), 6) as {c}"
    for c in FEATURES
)
_GAP = " + ".join(f"((a.{c} - b.{c}) / s.{c}) ** 2" for c in FEATURES)
_DEVS = ", ".join(f"case when stddev_pop({c}) > 1e-12 then stddev_pop({c}) else 1 end as {c}" for c in FEATURES)
_COLS = ", ".join(FEATURES)

ORACLES = {
    "incident_features": sql(_FEATURES, f"select incident_id, {_ROUNDED} from feat"),
    "standardised_features": sql(_FEATURES, f"select incident_id, {_SCALED} from feat"),
    "standardised_vectors": """
with e as (
  select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as pos from embeddings),
s as (select pos, avg(v) as m, stddev_pop(v) as d from e group by pos)
select vec_id, pos, round((v - m) / case when d > 1e-12 then d else 1 end, 5) as z from e join s using (pos)""",
    "density_families": sql(FAMILIES, "select incident_id, cluster_id from clustered"),
    "family_labels": sql(FAMILIES, "select cluster_id, cluster_label from names"),
    "top_families": sql(
        FAMILIES,
        """select cluster_id, cluster_label, count(*) as count, count(*) filter (severity_max = 'critical') as critical_count,
  round(avg(all_benign::int), 6) as all_benign_ratio, round(avg(member_count), 6) as mean_members
from clustered join names using (cluster_id) where cluster_id <> -1
group by all order by count desc, cluster_id limit 10""",
    ),
    "family_counts": sql(
        FAMILIES,
        "select count(distinct cluster_id) filter (cluster_id <> -1) as clusters,"
        " count(*) filter (cluster_id = -1) as noise, count(*) as incidents from clustered",
    ),
}
_SILHOUETTE = f"""{_FEATURES},
g as (select f.*, i.root_kind || i.severity_max as grp from feat f join incidents i using (incident_id)),
v as (select row_number() over () as id, * from (select grp, {_COLS}, count(*) as w from g group by all)),
n as (select grp, sum(w) as size from v group by grp),
s as (select {_DEVS} from feat),
d as (
  select a.id, a.grp, a.w, b.grp as other, sum(b.w * ({_GAP})) as total
  from v a, v b, s group by a.id, a.grp, a.w, b.grp),
m as (
  select id, d.grp, w, max(own.size) as size, max(case when other = d.grp then total / (own.size - 1) end) as inner_d,
    min(case when other <> d.grp then total / o.size end) as outer_d
  from d join n o on o.grp = other join n own on own.grp = d.grp group by id, d.grp, w)"""
ORACLES["silhouette"] = sql(
    _SILHOUETTE,
    "select round(sum(w * case when size = 1 then 0 else (outer_d - inner_d) / greatest(outer_d, inner_d) end)"
    " / sum(w), 6) as silhouette from m",
)
