"""Queries on links, addresses and the footnote graph of editions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import links as L
from palimpsest.plans.registry import query
from palimpsest.session import table

_HREF = r"""(?is)<a\b[^>]*?\shref\s*=\s*["'']([^"'']*)["'']"""
_E = "(SELECT DISTINCT edition_id, country, note, body FROM export_editions)"
_LINKS = f"SELECT edition_id, country, unnest(regexp_extract_all(coalesce(body, ''), '{_HREF}', 1)) AS href FROM {_E}"
_HOST = "lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_PATH = "regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_KIND = f"CASE WHEN starts_with(href, '#fn') THEN 'footnote' WHEN starts_with(href, '#') THEN 'anchor' WHEN starts_with(href, 'mailto:') THEN 'mailto' WHEN starts_with(href, '/') OR regexp_matches({_HOST.format('href')}, '(?:^|\\.)notes\\.example$') THEN 'own' ELSE 'external' END"


def editions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "export_editions").dropDuplicates(["edition_id"])


def all_links(spark: SparkSession, sf: str) -> DataFrame:
    return editions(spark, sf).select("edition_id", "country", F.explode(L.hrefs(F.col("body"))).alias("href"))


@query("X-18 F-17 SRC-16", f"SELECT edition_id, href, count(*) AS times FROM ({_LINKS}) GROUP BY ALL")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return all_links(spark, sf).groupBy("edition_id", "href").agg(F.count("*").alias("times"))


@query("F-01 A-02 A-22", f"SELECT country, {_KIND} AS kind, count(*) AS links FROM ({_LINKS}) GROUP BY ALL")
def link_summary(spark: SparkSession, sf: str) -> DataFrame:
    return all_links(spark, sf).groupBy("country", L.link_kind(F.col("href")).alias("kind")).agg(F.count("*").alias("links"))


_IDS = f"SELECT edition_id, unnest(regexp_extract_all(coalesce(body, ''), '(?is)<[a-z][^>]*?\\sid\\s*=\\s*\"([^\"]*)\"', 1)) AS id FROM {_E}"


@query("M-20 J-13 rule-1", f"SELECT DISTINCT edition_id, href FROM ({_LINKS}) l WHERE starts_with(href, '#') AND NOT EXISTS (SELECT 1 FROM ({_IDS}) i WHERE i.edition_id = l.edition_id AND i.id = substr(l.href, 2))")
def broken_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """References inside a page to a place that the page doesn't have."""
    ids = editions(spark, sf).select(F.col("edition_id").alias("e"), F.explode(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r'(?is)<[a-z][^>]*?\sid\s*=\s*"([^"]*)"'), F.lit(1))).alias("id"))
    refs = all_links(spark, sf).where(F.col("href").startswith("#")).withColumn("to", F.substring("href", 2, 1_000_000))
    return refs.join(ids, (F.col("edition_id") == F.col("e")) & (F.col("to") == F.col("id")), "left_anti").select("edition_id", "href").distinct()


@query("J-13 rule-2 X-18", f"""
WITH refs AS (SELECT edition_id, href, count(*) AS n FROM ({_LINKS}) WHERE starts_with(href, '#fn:') GROUP BY ALL), ids AS (SELECT edition_id, id, count(*) AS n FROM ({_IDS}) WHERE starts_with(id, 'fn:') GROUP BY ALL)
SELECT coalesce(r.edition_id, i.edition_id) AS edition_id, coalesce(substr(r.href, 2), i.id) AS footnote, coalesce(r.n, 0) AS refs, coalesce(i.n, 0) AS targets,
  CASE WHEN i.n IS NULL THEN 'candidate' WHEN i.n > 1 THEN 'candidate' WHEN r.n IS NULL THEN 'observation' WHEN r.n > 1 THEN 'observation' ELSE 'pass' END AS state
FROM refs r FULL JOIN ids i ON r.edition_id = i.edition_id AND substr(r.href, 2) = i.id""")
def footnote_graph(spark: SparkSession, sf: str) -> DataFrame:
    """References and targets of footnotes side by side: missing, repeated and unused ones."""
    r = all_links(spark, sf).where(F.col("href").startswith("#fn:")).groupBy("edition_id", F.substring("href", 2, 1_000_000).alias("footnote")).agg(F.count("*").alias("refs"))
    i = editions(spark, sf).select("edition_id", F.explode(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r'(?is)<[a-z][^>]*?\sid\s*=\s*"([^"]*)"'), F.lit(1))).alias("footnote")).where(F.col("footnote").startswith("fn:")).groupBy("edition_id", "footnote").agg(F.count("*").alias("targets"))
    j = r.join(i, ["edition_id", "footnote"], "full")
    state = F.when(F.coalesce("targets", F.lit(0)) != 1, "candidate").when(F.coalesce("refs", F.lit(0)) != 1, "observation").otherwise("pass")
    return j.select("edition_id", "footnote", F.coalesce("refs", F.lit(0)).alias("refs"), F.coalesce("targets", F.lit(0)).alias("targets"), state.alias("state"))


_D = "(SELECT DISTINCT download_id, original_url, url, provider, status, sha256, bytes, country FROM repository_downloads)"
_URLS = f"SELECT download_id, u FROM (SELECT download_id, unnest([original_url, url]) AS u FROM {_D}) WHERE u IS NOT NULL"
_RAW = "(SELECT download_id, url, original_url, CASE status WHEN 'saved' THEN 200 WHEN 'skipped' THEN 403 ELSE 404 END AS code FROM repository_downloads GROUP BY ALL)"
_MOVED = f"(regexp_replace({_HOST.format('original_url')}, '^www\\.', '') <> regexp_replace({_HOST.format('url')}, '^www\\.', '') OR lower(regexp_replace({_PATH.format('original_url')}, '/+$', '')) <> lower(regexp_replace({_PATH.format('url')}, '/+$', '')))"


@query("F-02 F-03 F-04 A-01", f"SELECT CASE WHEN code IN (404, 410) THEN 'broken' WHEN code IN (401, 403, 429, 451) THEN 'restricted' WHEN {_MOVED} THEN 'moved' ELSE 'ok' END AS state, count(*) AS links FROM {_RAW} GROUP BY 1")
def link_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Downloads as outcomes of their original address, counted."""
    d = table(spark, sf, "repository_downloads").dropDuplicates(["download_id"])
    code = F.when(F.col("status") == "saved", 200).when(F.col("status") == "skipped", 403).otherwise(404)
    return d.groupBy(L.link_status(code, F.col("original_url"), F.col("url"), F.lit(None).cast("string")).alias("state")).agg(F.count("*").alias("links"))


@query("F-13 F-20 F-09 F-08 F-10 F-26", f"""
SELECT u, CASE WHEN regexp_matches(u, '(?i)^https?://[^/?#\\s@]+(?:[/?#]\\S*)?$') THEN lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) || '://' || {_HOST.format('u')} || coalesce(nullif(regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^#]*)', 1), ''), '/') END AS safe,
  coalesce(nullif(regexp_extract({_PATH.format('u')}, '/(?:item|files)/([^/]+)', 1), ''), nullif(regexp_replace(string_split({_PATH.format('u')}, '/')[-1], '\\.\\w+$', ''), '')) AS asset,
  CASE WHEN regexp_matches(lower({_PATH.format('u')}), '\\.(?:pdf|docx?|xlsx?|csv|ods|odt)$') THEN 'file' WHEN regexp_matches({_HOST.format('u')}, 'notes\\.example$') THEN 'html' ELSE 'other' END AS kind
FROM (SELECT DISTINCT u FROM ({_URLS}))""")
def addresses(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "repository_downloads").select(F.explode(F.array("original_url", "url")).alias("u")).where("u IS NOT NULL").distinct()
    u = F.col("u")
    return d.select("u", L.safe_url(u).alias("safe"), L.asset_key(u).alias("asset"), L.attachment_kind(u).alias("kind"))


@query("J-03 SRC-06 SNK-07 A-07", f"""
WITH x AS (SELECT {_HOST.format('url')} AS host, country, status, bytes FROM {_D} WHERE url IS NOT NULL)
SELECT host, count(*) AS downloads, count(DISTINCT country) AS countries, bool_or(status = 'failed') AS any_failed, list_sort(list(DISTINCT country)) AS used_by, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM x GROUP BY host""")
def cited_hosts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "repository_downloads").dropDuplicates(["download_id"]).where("url IS NOT NULL")
    return d.groupBy(L.host(F.col("url")).alias("host")).agg(F.count("*").alias("downloads"), F.countDistinct("country").alias("countries"), F.bool_or(F.col("status") == "failed").alias("any_failed"), F.array_sort(F.collect_set("country")).alias("used_by"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))


@query("SNK-07 S-07", f"SELECT c.country, coalesce(n.failed, 0) AS failed FROM (SELECT DISTINCT country FROM official_titles) c LEFT JOIN (SELECT country, count(*) AS failed FROM {_D} WHERE status = 'failed' GROUP BY 1) n ON n.country = c.country")
def failures_of_every_country(spark: SparkSession, sf: str) -> DataFrame:
    """A row for every country, also those without failures."""
    c = table(spark, sf, "official_titles").select("country").distinct()
    n = table(spark, sf, "repository_downloads").dropDuplicates(["download_id"]).where("status = 'failed'").groupBy("country").agg(F.count("*").alias("failed"))
    return c.join(n, "country", "left").select("country", F.coalesce("failed", F.lit(0)).alias("failed"))


#: Downloads as outcomes of every kind: what came back, where and with which code, is dealt out by their ids.
_CASES = """SELECT download_id, original_url AS url, CASE download_id % 6 WHEN 0 THEN original_url WHEN 1 THEN url WHEN 2 THEN regexp_replace(original_url, '^(https?://[^/]*).*$', '{back}1/') WHEN 3 THEN upper(replace(original_url, 'https://', 'https://www.')) WHEN 4 THEN concat(url, '/page-not-found') END AS final,
  CASE download_id % 9 WHEN 0 THEN 404 WHEN 1 THEN 410 WHEN 2 THEN 403 WHEN 3 THEN 503 WHEN 4 THEN 301 ELSE 200 END AS code, CASE WHEN download_id % 11 = 0 THEN 'timeout' WHEN download_id % 11 = 1 THEN '' END AS error FROM {source}"""


_FP, _UP = _PATH.format("coalesce(final, '')"), _PATH.format("url")


@query("F-02 F-03 F-04 F-15 M-14", f"""
SELECT download_id, CASE WHEN error <> '' THEN 'unreachable' WHEN code IN (404, 410) THEN 'broken' WHEN code IN (401, 403, 429, 451) THEN 'restricted' WHEN code >= 500 THEN 'server-error'
  WHEN code BETWEEN 200 AND 299 THEN CASE WHEN final IS NULL THEN 'ok'
    WHEN regexp_matches({_FP} || '?' || regexp_extract(final, '^[^?#]*\\?([^#]*)', 1), '(?i)suspendedpage|/404\\b|not-?found|error-?page|/expired') OR regexp_matches({_HOST.format('final')}, '(?:hugedomains|dan|sedo|afternic|bodis|parkingcrew)\\.(?:com|net)$')
      OR (trim({_FP}, '/') = '' AND trim({_UP}, '/') NOT IN ('', 'index.html', 'index.htm', 'en')) THEN 'broken'
    WHEN regexp_replace({_HOST.format('url')}, '^www\\.', '') <> regexp_replace({_HOST.format('final')}, '^www\\.', '') OR lower(rtrim({_UP}, '/')) <> lower(rtrim({_FP}, '/')) THEN 'moved' ELSE 'ok' END ELSE 'other' END AS state
FROM ({_CASES.format(back=chr(92), source='(SELECT DISTINCT download_id, original_url, url FROM repository_downloads)')}) t""")
def link_status_cases(spark: SparkSession, sf: str) -> DataFrame:
    """The status of every outcome, the first that holds."""
    d = spark.sql(_CASES.format(back="$", source="{d}"), d=table(spark, sf, "repository_downloads").select("download_id", "original_url", "url").distinct())
    return d.select("download_id", L.link_status(F.col("code"), F.col("url"), F.col("final"), F.col("error")).alias("state"))


_VOL = "SELECT DISTINCT download_id, concat(url, CASE download_id % 4 WHEN 0 THEN '?utm_source=x&id=3#top' WHEN 1 THEN '?ref=1' WHEN 2 THEN concat('?&utm_medium=a&page=', download_id) ELSE '' END) AS u FROM {source}"


@query("F-20", "SELECT download_id, regexp_extract(u, '^([^?#]*)', 1) || CASE WHEN k = '' THEN '' ELSE '?' || k END AS stable FROM (SELECT download_id, u, array_to_string(list_filter(string_split(regexp_extract(u, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_\\w+|ref|session|sid|fbclid|gclid)=')), '&') AS k FROM (" + _VOL.format(source="repository_downloads") + ") t)")
def stable_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses without query parameters that say nothing about the page."""
    d = spark.sql(_VOL.format(source="{d}"), d=table(spark, sf, "repository_downloads"))
    return d.select("download_id", L.stable_url(F.col("u")).alias("stable"))
