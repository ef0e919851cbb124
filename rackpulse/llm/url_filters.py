"""Block decisions for URLs that reach all aliases of a blocked one.

* Every URL is a node. Edges are canonical links and refresh redirects read from the pages' HTML, redirects that a crawler
  recorded (a table), and those that sites use by convention: to https, to the host without ``www.`` or ``m.``, to the URL
  without fragment and tracking parameters.
* The connected components of these edges are classes of aliases.
* A rule has a host and a path. It fits a URL on that host or a subdomain whose path starts with the rule's; the longest one
  (host and path together) decides; of equally long ones that with the longer host, and allow before block.
* A URL with a rule keeps the rule's verdict. One without is blocked if some URL of its class is blocked by a rule and none
  is allowed by one: an explicit allow takes precedence. All others are allowed.

Rules are found by joins on (end of the host, start of the path), so neither their number nor that of the URLs is bounded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackpulse.llm.link_components import link_components
from rackpulse.session import materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^(.*?)://([^/?#]*)([^?#]*)"
_TAGS = r"(?is)<(?:link|meta)\b[^>]*>"
_UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>"
_CANONICAL = r"(?is)^<link\b.*\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"
_REFRESH = r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"
#: Parameters that tell where a visitor came from, not what they see.
TRACKING = r"(?i)^(utm_[^=]*|ref|gclid|fbclid)(=.*)?$"


#: Verdicts of the rules; the least of both is the one that takes precedence.
ALLOW, BLOCK = "allow", "block"


def ascii_lower(value: Column) -> Column:
    return F.translate(value, _UPPER, _LOWER)


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, in small letters; empty without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, _PARTS, 2)), F.lit(""))


def url_path(url: Column) -> Column:
    """From behind the host to the next ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit(""))


def conventional_form(url: Column) -> Column:
    """Where a URL of a usual site redirects to, itself included."""
    host = F.regexp_replace(url_host(url), r"^(?:www|m)\.(?=.)", "")
    host = F.regexp_replace(host, r":(?:80|443)$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~p.rlike(TRACKING))
    path = F.when(url_path(url) == "", F.lit("/")).otherwise(url_path(url))
    scheme = ascii_lower(F.regexp_extract(url, _PARTS, 1))
    scheme = F.when(scheme == "http", F.lit("https")).otherwise(scheme)
    return F.concat(scheme, F.lit("://"), host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def resolve(base: Column, link: Column) -> Column:
    """A link of the page ``base`` as a whole URL; steps like ``..`` stay as they are."""
    scheme = F.regexp_extract(base, _PARTS, 1)
    site = F.concat(scheme, F.lit("://"), url_host(base))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?") | link.startswith("#"), F.concat(site, url_path(base), link))
        .otherwise(F.concat(site, F.when(url_path(base) == "", F.lit("/")).otherwise(F.regexp_replace(url_path(base), r"[^/]*$", "")), link))
    )


def declared_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (src, dst) that pages declare: canonical links and refresh redirects, outside comments and scripts."""
    told = pages.select(F.col(url).alias("src"), F.col(html).alias("page")).filter(F.col("page").rlike(r"(?i)canonical|http-equiv"))
    tags = told.filter(url_host(F.col("src")) != "").select("src", F.explode(F.expr(f"regexp_extract_all(regexp_replace(page, r\"{_UNSEEN}\", ''), r\"{_TAGS}\", 0)")).alias("tag"))
    href = F.regexp_extract("tag", r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", 0)
    href = F.regexp_replace(href, r"(?is)^href\s*=\s*[\"']?|[\"']$", "")
    moved = F.regexp_extract("tag", r"(?is)\burl\s*=\s*[\"']?\s*([^\"'>\s]+)", 1)
    link = F.when(F.col("tag").rlike(_CANONICAL), href).when(F.col("tag").rlike(_REFRESH), moved)
    link = F.trim(F.regexp_replace(link, "&amp;", "&"))
    return tags.select("src", link.alias("link")).filter("link <> ''").select("src", resolve(F.col("src"), F.col("link")).alias("dst")).distinct()


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, rule, verdict) of the rows (id, host, path) that a rule (host, path, verdict) fits; ids are distinct."""
    own = rules.filter(f"host <> '' and path is not null and verdict in ('{ALLOW}', '{BLOCK}')").select(
        ascii_lower(F.col("host")).alias("end"), F.col("path").alias("start"), "verdict"
    )
    # Of one rule with both verdicts, allow stays.
    own = own.groupBy("end", "start").agg(F.min("verdict").alias("verdict"))
    labels = own.agg(F.max(F.size(F.split("end", r"\."))).alias("n")).first()["n"] or 1
    lengths = own.groupBy("end").agg(F.collect_set(F.length("start")).alias("lengths"))
    ends = F.expr(f"array_distinct(transform(sequence(1, {labels}), k -> substring_index(host, '.', -k)))")
    reached = urls.select("id", "path", F.explode(ends).alias("end")).join(lengths, "end")
    fits = F.filter("lengths", lambda n: n <= F.length("path"))
    starts = reached.select("id", "end", F.explode(F.transform(fits, lambda n: F.substring("path", F.lit(1), n))).alias("start"))
    found = starts.join(own, ["end", "start"])
    rank = F.struct((F.length("end") + F.length("start")).alias("size"), F.length("end").alias("host_size"))
    best = found.groupBy("id").agg(F.max_by(F.struct(F.concat("end", "start").alias("rule"), "verdict"), rank).alias("best"))
    return best.select("id", "best.rule", "best.verdict")


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """Rows (``key``, host, path, rule, verdict), one per row of ``pages``.

    ``redirects`` holds (src, dst) as a crawler recorded them. A null URL and one without ``://`` have neither host nor path,
    no rule and no aliases, and are allowed. Rows with one URL get one verdict. Null HTML declares nothing. Rules without host
    or with another verdict than allow or block are no rules. Other columns of ``pages`` have no influence.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
    named = lambda c: F.unhex(F.md5(c))  # noqa: E731 - 128 bits
    declared = declared_links(pages, url, html)
    if redirects is not None:
        declared = declared.unionByName(redirects.select("src", "dst").filter("src like '%://%' and dst like '%://%'"))
    declared = materialise(declared, "declared-links")
    seen = reduce(DataFrame.unionByName, [rows.select("url"), declared.select(F.col("src").alias("url")), declared.select(F.col("dst").alias("url"))])
    seen = seen.filter(url_host(F.col("url")) != "").distinct()
    edges = seen.select(F.col("url").alias("src"), conventional_form(F.col("url")).alias("dst")).filter("src <> dst")
    edges = materialise(edges.unionByName(declared), "aliases")
    urls = seen.unionByName(edges.select(F.col("dst").alias("url"))).distinct()
    urls = urls.select(named("url").alias("id"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    ruled = materialise(fitting_rules(urls, rules), "ruled")
    classes = link_components(edges.select(named("src").alias("a"), named("dst").alias("b"))).withColumnRenamed("node", "id")
    members = materialise(classes.join(ruled, "id", "left").select("id", "component", "verdict"), "members")
    blocked = members.groupBy("component").agg(F.min("verdict").alias("low")).filter(F.col("low") == BLOCK)
    reached = members.filter("verdict is null").join(blocked, "component", "left_semi").select("id", F.lit(None).cast("string").alias("rule"), F.lit(BLOCK).alias("verdict"))
    decided = ruled.unionByName(reached)
    # A row without a URL has a name that no URL has, another one each, so that such rows do not meet in one task.
    own = F.when(url_host(F.col("url")) != "", named("url")).otherwise(named(F.rand(3).cast("string")))
    judged = rows.withColumn("id", own).join(decided, "id", "left")
    return judged.select(
        F.col("key").alias(key), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), "rule",
        F.coalesce("verdict", F.lit(ALLOW)).alias("verdict"),
    )


#: The classes by a recursive query over the same edges.
ORACLE = r"""
with recursive rules(end_, start, verdict) as (
  values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
),
tags as materialized (
  select url, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->|<script\b.*?</script\s*>', '', 'gis'), '<(?:link|meta)\b[^>]*>', 0, 'is')) as tag
  from pages where html ilike '%canonical%' or html ilike '%http-equiv%'
),
targets as materialized (
  select url, trim(replace(case
    when regexp_matches(tag, '^<link\b.*\brel\s*=\s*["'']?[^"''>]*\bcanonical\b', 'is')
      then regexp_replace(regexp_extract(tag, '\bhref\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s>"'']+)', 0, 'is'), '^href\s*=\s*["'']?|["'']$', '', 'gis')
    when regexp_matches(tag, '^<meta\b.*\bhttp-equiv\s*=\s*["'']?\s*refresh\b', 'is')
      then regexp_extract(tag, '\burl\s*=\s*["'']?\s*([^"''>\s]+)', 1, 'is') end, '&amp;', '&')) as link
  from tags where contains(url, '://')
),
site as (
  select url, link, regexp_extract(url, '^(.*?)://', 1, 's') as scheme, regexp_extract(url, '^.*?://([^/?#]*)', 1, 's') as host,
    regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') as path
  from targets where link <> ''
),
declared as materialized (
  select url as a, case when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.\-]*://') then link when link like '//%' then scheme || ':' || link
    when link like '/%' then scheme || '://' || lower(host) || link when link like '?%' or link like '#%' then scheme || '://' || lower(host) || path || link
    else scheme || '://' || lower(host) || (case when path = '' then '/' else regexp_replace(path, '[^/]*$', '') end) || link end as b
  from site
),
seen as materialized (
  select url from pages where contains(url, '://') union select a from declared union select b from declared where contains(b, '://')
),
formed as materialized (
  select url as a, case lower(regexp_extract(url, '^(.*?)://', 1, 's')) when 'http' then 'https' else lower(regexp_extract(url, '^(.*?)://', 1, 's')) end || '://'
    || regexp_replace(regexp_replace(lower(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')), '^(?:www|m)\.(.)', '\1'), ':(?:80|443)$', '')
    || (case when regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') = '' then '/' else regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') end)
    || coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1, 's'), '&'),
      lambda p: p <> '' and not regexp_matches(p, '^(utm_[^=]*|ref|gclid|fbclid)(=.*)?$', 'i')), '&'), ''), '') as b
  from seen
),
edges as materialized (select a, b from formed where a <> b union select a, b from declared union select b, a from formed where a <> b union select b, a from declared),
urls as materialized (select url from seen union select b from formed),
cut as materialized (
  select url, lower(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')) as host, regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') as path from urls
),
best as materialized (
  select url, arg_max(end_ || start, length(end_) + length(start)) as rule, arg_max(verdict, length(end_) + length(start)) as verdict
  from cut join rules on (host = end_ or host like '%.' || end_) and starts_with(path, start) group by url
),
reach(a, b) as (select url, url from urls union select r.a, e.b from reach r join edges e on e.a = r.b),
classes as materialized (
  select r.a as url, bool_or(verdict = 'block') as blocked, bool_or(verdict = 'allow') as allowed from reach r join best on best.url = r.b group by r.a
)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, rule,
  coalesce(verdict, case when blocked and not allowed then 'block' else 'allow' end) as verdict
from pages left join cut using (url) left join best using (url) left join classes using (url)
"""
