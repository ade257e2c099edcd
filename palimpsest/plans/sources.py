"""Queries on sources and readings: quality of what came back, guarded hosts, readings of a text, names of sections, same files, paired editions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import links as L
from palimpsest.functions import text as T
from palimpsest.operators import align as A
from palimpsest.operators import relational as R
from palimpsest.operators.neighbours import beside_previous
from palimpsest.plans.registry import query
from palimpsest.session import once, table

_D = "(SELECT DISTINCT ON (download_id) * FROM repository_downloads)"
_HOST = "lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_PATH = "regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_SOFT = f"""(regexp_matches({_PATH.format('url')} || '?' || regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '(?i)suspendedpage|/404\\b|not-?found|page-?not-?found|error-?page|/expired')
  OR regexp_matches({_HOST.format('url')}, '(?i)(?:hugedomains|dan|sedo|afternic|bodis|parkingcrew)\\.(?:com|net)$') OR (trim({_PATH.format('url')}, '/') = '' AND trim({_PATH.format('original_url')}, '/') NOT IN ('', 'index.html', 'index.htm', 'en')))"""


def downloads(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return once(table(spark, sf, "repository_downloads").select("download_id", *columns), "download_id")


@query("F-14", f"SELECT download_id, CASE WHEN url <> original_url AND {_SOFT} THEN 'redirect_needs_check' WHEN regexp_matches(trim(coalesce(edition, '')), '{L.ERROR_TITLE}') THEN 'access_or_error_page' WHEN status = 'saved' THEN 'extracted' ELSE coalesce(status, 'missing') END AS quality FROM {_D}")
def source_quality(spark: SparkSession, sf: str) -> DataFrame:
    """What came back for each download: an error page by its address or title, a readable source, or its status."""
    d = downloads(spark, sf, "original_url", "url", "edition", "status")
    return d.select("download_id", L.source_quality(F.col("original_url"), F.col("url"), F.col("edition"), F.col("status")).alias("quality"))


_IP = "regexp_full_match(host, '(?:\\d{1,3}\\.){3}\\d{1,3}(?::\\d+)?')"
_OCTET = "CAST(nullif(regexp_extract(host, '^(\\d+)\\.(\\d+)\\.(\\d+)\\.(\\d+)', {0}), '') AS INTEGER)"
_A, _B, _C = (_OCTET.format(i) for i in (1, 2, 3))


@query("F-16", f"""
WITH h AS (SELECT DISTINCT {_HOST.format('u')} AS host FROM (SELECT unnest([original_url, url]) AS u FROM repository_downloads UNION ALL SELECT archive_url FROM captures UNION ALL SELECT 'http://' || (p_partkey % 256) || '.' || (p_size % 256) || '.' || (p_partkey * 7 % 256) || '.9/x' FROM part) WHERE u IS NOT NULL)
SELECT host, CASE WHEN host = 'localhost' OR ends_with(host, '.localhost') THEN 'private' WHEN NOT {_IP} THEN 'name' WHEN {_A} > 255 OR {_B} > 255 OR {_C} > 255 THEN 'name'
  WHEN {_A} IN (0, 10, 127) OR {_A} >= 224 OR ({_A} = 100 AND {_B} BETWEEN 64 AND 127) OR ({_A} = 169 AND {_B} = 254) OR ({_A} = 172 AND {_B} BETWEEN 16 AND 31) OR ({_A} = 192 AND {_B} = 168) OR ({_A} = 192 AND {_B} = 0 AND {_C} IN (0, 2)) OR ({_A} = 198 AND {_B} IN (18, 19)) OR ({_A} = 198 AND {_B} = 51 AND {_C} = 100) OR ({_A} = 203 AND {_B} = 0 AND {_C} = 113) THEN 'private' ELSE 'public' END AS kind
FROM h""")
def guarded_hosts(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts by whether they may be fetched: literal addresses are public or not, names are for the resolver. Addresses of parts stand in for literal ones."""
    d, c, p = table(spark, sf, "repository_downloads"), table(spark, sf, "captures"), table(spark, sf, "part")
    ip = F.concat(F.lit("http://"), F.concat_ws(".", (F.col("p_partkey") % 256).cast("string"), (F.col("p_size") % 256).cast("string"), (F.col("p_partkey") * 7 % 256).cast("string"), F.lit("9/x")))
    u = d.select(F.explode(F.array("original_url", "url")).alias("u")).unionAll(c.select("archive_url")).unionAll(p.select(ip)).where("u IS NOT NULL")
    h = u.select(L.host(F.col("u")).alias("host")).distinct()
    return h.select("host", L.host_kind(F.col("host")).alias("kind"))


@query("F-23", f"SELECT note, arg_max(status, CASE status WHEN 'failed' THEN 3 WHEN 'skipped' THEN 2 WHEN 'saved' THEN 1 ELSE 0 END) AS worst, count(*) AS sources FROM (SELECT * FROM {_D} QUALIFY row_number() OVER (PARTITION BY note, url ORDER BY download_id DESC) = 1) GROUP BY note")
def worst_status(spark: SparkSession, sf: str) -> DataFrame:
    """The gravest status of a note's sources; of several records of one source only the last is active."""
    d = R.last_per_key(downloads(spark, sf, "note", "url", "status"), ["note", "url"], ["download_id"])
    severity = F.when(F.col("status") == "failed", 3).when(F.col("status") == "skipped", 2).when(F.col("status") == "saved", 1).otherwise(0)
    return d.groupBy("note").agg(F.max_by("status", severity).alias("worst"), F.count("*").alias("sources"))


_W = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
_MARKS, _FURNITURE = "(?i)\\[(?:footnote\\s+)?\\d{1,4}\\]|[⁰¹²³⁴-⁹]+", "(?im)^[ \\t]*(?:(?:page )?\\d{1,4}(?: of \\d{1,4})?|back to contents)[ \\t]*$"


@query("CMP-03 CMP-04", f"SELECT doc_id, len({_W.format('t')}) AS plain, len({_W.format(f'regexp_replace(t, {_MARKS!r}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')}) AS without_marks, len({_W.format(f'regexp_replace(regexp_replace(t, {_MARKS!r}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)}), {_FURNITURE!r}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')}) AS flow FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)".replace("\\\\", "\\"))
def text_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each document read three ways: as it comes, without marks of notes, and without page furniture too."""
    t = F.coalesce("text", F.lit(""))
    r = A.readings(t)
    return table(spark, sf, "documents").select("doc_id", *[F.size(T.words(r[k])).cast("long").alias(k) for k in ("plain", "without_marks", "flow")])


_FLAT = "' ' || array_to_string(regexp_extract_all(lower(regexp_replace({0}, '<[^>]*>', ' ', 'g')), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' '"


@query("M-24 M-39", f"""
WITH p AS (SELECT edition_id, body, lag(body) OVER (PARTITION BY note ORDER BY first_seen, edition_id) AS before FROM (SELECT DISTINCT ON (edition_id) * FROM export_editions)),
h AS (SELECT DISTINCT edition_id, body, unnest(regexp_extract_all(before, '<h2[^>]*>([^<]*)</h2>', 1)) AS heading FROM p WHERE before IS NOT NULL)
SELECT edition_id, heading, nullif(list_position(list_transform(string_split_regex(coalesce(body, ''), '<h2'), lambda x: contains({_FLAT.format("'<h2' || x")}, {_FLAT.format('heading')})), TRUE), 0) AS page FROM h""")
def pages_of_headings(spark: SparkSession, sf: str) -> DataFrame:
    """The first page (section) of an edition that has the words of each heading of the edition before; null if none has."""
    e = once(table(spark, sf, "export_editions").select("edition_id", "note", "first_seen", "body"), "edition_id")
    p = beside_previous(e, "note", ["first_seen", "edition_id"], "edition_id", ["body"])
    flat = lambda c: A.padded(T.words(F.regexp_replace(c, "<[^>]*>", " ")))
    pages = F.transform(F.split(F.coalesce("body", F.lit("")), "<h2"), lambda x: flat(F.concat(F.lit("<h2"), x)))
    h = p.select("edition_id", pages.alias("pages"), F.explode(F.array_distinct(F.regexp_extract_all("previous_body", F.lit("<h2[^>]*>([^<]*)</h2>"), F.lit(1)))).alias("heading"))
    return h.select("edition_id", "heading", A.page_of(F.col("pages"), flat(F.col("heading"))).alias("page"))


@query("X-26")
def section_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of an edition's sections that its paragraphs mention (tested on its own)."""
    e = once(table(spark, sf, "export_editions").select("edition_id", "body"), "edition_id")
    heads = F.array_distinct(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit("(?i)<h[1-6][^>]*>([^<]*)</h[1-6]>"), F.lit(1)))
    paragraphs = F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"(?is)<(?:p|li)\b[^>]*>(.*?)</(?:p|li)\s*>"), F.lit(1))
    x = e.select("edition_id", heads.alias("heads"), F.explode(F.transform(paragraphs, lambda p: T.without_markup(p))).alias("paragraph"))
    return x.select("edition_id", F.explode(T.names_in(F.col("paragraph"), F.col("heads"))).alias("name")).groupBy("edition_id", "name").agg(F.count("*").alias("mentions"))


_NAME = "regexp_extract(original_url, '([^/]*)$', 1)"


@query("J-11", f"""
WITH RECURSIVE i AS (SELECT original_url AS u, min(edition) AS t, {_NAME} AS f, min(pages) AS p, min(sha256) AS h FROM {_D} GROUP BY original_url),
g AS (SELECT t, f, p, min(u) AS first FROM i GROUP BY ALL),
e AS (SELECT u AS a, 'sha ' || h AS b FROM i WHERE h IS NOT NULL UNION ALL SELECT i.u, g.first FROM i JOIN g ON i.t IS NOT DISTINCT FROM g.t AND i.f = g.f AND i.p IS NOT DISTINCT FROM g.p WHERE i.h IS NULL),
n AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), reach(x, y) AS (SELECT x, x FROM (SELECT DISTINCT x FROM n) UNION SELECT r.x, n.y FROM reach r JOIN n ON r.y = n.x)
SELECT x AS address, min(y) AS file FROM reach WHERE NOT starts_with(x, 'sha ') GROUP BY x""")
def same_files(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses that hold one file: equal digests, or equal title, name and pages where one has no digest. Groups hang on one node each: no pairs."""
    d = downloads(spark, sf, "original_url", "edition", "pages", "sha256").where("original_url IS NOT NULL")
    i = d.groupBy(F.col("original_url").alias("u")).agg(F.min("edition").alias("t"), F.min("pages").alias("p"), F.min("sha256").alias("h")).withColumn("f", F.regexp_extract("u", "([^/]*)$", 1))
    first = i.groupBy("t", "f", "p").agg(F.min("u").alias("b")).withColumnsRenamed({"t": "t_", "f": "f_", "p": "p_"})
    loose = i.where("h IS NULL").join(first, F.col("t").eqNullSafe(F.col("t_")) & (F.col("f") == F.col("f_")) & F.col("p").eqNullSafe(F.col("p_"))).select(F.col("u").alias("a"), "b")
    edges = i.where("h IS NOT NULL").select(F.col("u").alias("a"), F.concat(F.lit("sha "), "h").alias("b")).unionByName(loose)
    return R.components(edges, "a", "b").where(~F.col("node").startswith("sha ")).select(F.col("node").alias("address"), F.col("component").alias("file"))


@query("J-01 J-02")
def paired_editions(spark: SparkSession, sf: str) -> DataFrame:
    """Web and PDF editions of a note paired one to one: equal titles first, then the likest title of the same month (0.6) or of none (0.9).

    Titles are compared once each, not edition by edition. (Tested on its own.)
    """
    e = once(table(spark, sf, "export_editions").select("edition_id", "note", "title", "source"), "edition_id").where("title IS NOT NULL")
    return R.paired_by_title(e.where("source <> 'pdf'"), e.where("source = 'pdf'"), "note", "edition_id", "title").select("edition_id", "twin", "by")
