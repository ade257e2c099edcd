"""Further queries: address books, queues, anchors, attribution, structure, registries. Mostly one SQL text for Spark and the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import bound, words
from palimpsest.operators import numbers as N
from palimpsest.operators import relational as R
from palimpsest.operators.neighbours import beside_previous
from palimpsest.plans.registry import both, query
from palimpsest.session import table

_E = "(SELECT edition_id, max(country) AS country, max(note) AS note, max(title) AS title, max(source) AS source, max(first_seen) AS first_seen, max(text_sha256) AS text_sha256, max(version_banner) AS version_banner, max(body) AS body, max(bytes) AS bytes FROM {export_editions} GROUP BY edition_id)"
_D = "(SELECT DISTINCT download_id, original_url, url, provider, country, note, edition, status, sha256, bytes, pages FROM {repository_downloads})"
_C = "(SELECT DISTINCT capture_id, edition_id, provider, archive_url, digest FROM {captures})"

both("download_audit", "A-06 M-27", f"SELECT status, count(*) AS downloads, count(DISTINCT note) AS notes, count(DISTINCT sha256) AS files, count_if(pages IS NULL) AS without_pages, count_if(provider IS NULL) AS without_provider FROM {_D} d GROUP BY status")
both("same_destination", "M-09", f"SELECT url, count(*) AS addresses, min(original_url) AS first_address, array_sort(collect_set(country)) AS countries FROM {_D} d GROUP BY url HAVING count(*) > 0")
both("fair_queue", "O-13 ST-06", f"SELECT download_id, provider, row_number() OVER (PARTITION BY provider ORDER BY download_id) AS turn FROM {_D} d WHERE status <> 'saved'")
both("unknown_digests", "ST-21", f"SELECT c.capture_id, c.edition_id FROM {_C} c WHERE NOT EXISTS (SELECT 1 FROM {{captures}} p WHERE p.digest = c.digest AND p.capture_id < c.capture_id) AND NOT EXISTS (SELECT 1 FROM {{stamp_sources}} s WHERE s.provider = c.provider AND s.zone = 'Etc/UTC')")
both("answers_with_fallback", "M-11", f"SELECT edition_id, digest, min(capture_id) AS capture_id FROM (SELECT * FROM {_C} a WHERE provider = 'notes-api' UNION ALL SELECT * FROM {_C} b WHERE provider <> 'notes-api' AND NOT EXISTS (SELECT 1 FROM {{captures}} x WHERE x.edition_id = b.edition_id AND x.provider = 'notes-api')) u GROUP BY edition_id, digest")
both("edition_rows", "M-01 F-06", f"SELECT edition_id, note, coalesce(title, note) AS title, source, coalesce(version_banner, 'none') AS version, source = 'live' AS live, CASE WHEN body IS NULL THEN 'missing' WHEN body = '' THEN 'empty' ELSE 'held' END AS body_state FROM {_E} e")
both("link_targets", "M-07", f"SELECT href, count(DISTINCT note) AS notes, count(*) AS links FROM (SELECT note, explode(regexp_extract_all(coalesce(body, ''), 'href=\"([^\"]*)\"', 1)) AS href FROM {_E} e) x GROUP BY href")
both("report_contexts", "M-16 J-21", f"SELECT e.edition_id, e.note FROM {_E} e WHERE EXISTS (SELECT 1 FROM {{repository_downloads}} d WHERE d.note = e.note AND d.status = 'saved')")
both("still_as_listed", "M-21 CMP-20 CMP-31", f"SELECT e.edition_id, max(CASE WHEN lower(s.text_sha256) = lower(e.text_sha256) THEN 1 ELSE 0 END) AS same FROM {_E} e JOIN {{note_snapshots}} s ON s.note = e.note GROUP BY e.edition_id")
both("registry_conflicts", "M-45 M-49", "SELECT note, count(DISTINCT country) AS countries, count(DISTINCT edition_id) AS editions FROM (SELECT note, country, edition_id FROM {export_editions} UNION ALL SELECT note, country, edition_id FROM {title_log} UNION ALL SELECT note, country, CAST(NULL AS BIGINT) FROM {repository_downloads}) x GROUP BY note HAVING count(DISTINCT country) > 0")
both("last_manual_reading", "M-44 M-43", "SELECT edition_id, max_by(log_id, struct(received_at, log_id)) AS log_id, count(DISTINCT log_id) AS readings FROM {title_log} WHERE title IS NOT NULL GROUP BY edition_id")
both("structure_counts", "CMP-15 X-17", f"SELECT edition_id, size(regexp_extract_all(coalesce(body, ''), '<h[1-6][ >]', 0)) AS headings, size(regexp_extract_all(coalesce(body, ''), '<p[ >]', 0)) AS paragraphs, size(regexp_extract_all(coalesce(body, ''), '<li[ >]', 0)) AS items, size(regexp_extract_all(coalesce(body, ''), '<table[ >]', 0)) AS tables, size(regexp_extract_all(coalesce(body, ''), 'href=\"#fn:', 0)) AS notes FROM {_E} e")
both("heading_index", "M-39", f"SELECT edition_id, slug, min(heading) AS heading, count(*) AS times FROM (SELECT edition_id, heading, regexp_replace(lower(trim(heading)), '[^a-z0-9]', '-') AS slug FROM (SELECT edition_id, explode(regexp_extract_all(coalesce(body, ''), '<h2[^>]*>([^<]*)</h2>', 1)) AS heading FROM {_E} e) x) y GROUP BY edition_id, slug".replace("'[^a-z0-9]', '-')", "'[^a-z0-9]', '')"))
both("marked_titles", "M-58 F-16", "SELECT title_id, regexp_replace(title, '(prison conditions|land disputes|prison|land)', '<$1>') AS marked FROM {official_titles}")
both("captions", "M-33 M-37 F-24", f"SELECT edition_id, coalesce(version_banner, title, note) AS caption, CASE WHEN version_banner IS NOT NULL THEN 'version' WHEN title IS NOT NULL THEN 'title' ELSE 'note' END AS caption_from FROM {_E} e")
both("formatted_citations", "X-30 M-36", "SELECT title_id, concat(country, ', ', title, ' [', CAST(title_id AS STRING), ']') AS citation, concat('#:~:text=', replace(title, ' ', '%20')) AS fragment FROM {official_titles}")
both("stale_pairs", "S-08 CMP-18", f"SELECT DISTINCT d.note FROM {_D} d WHERE NOT EXISTS (SELECT 1 FROM {{export_editions}} e WHERE e.note = d.note)")
both("badge_counts", "M-50 M-56", f"SELECT note, count(*) AS editions, count(DISTINCT text_sha256) AS texts, count(*) - count(DISTINCT text_sha256) AS repeats FROM {_E} e GROUP BY note")
both("two_steps_away", "ST-16", f"SELECT note, min(depth) AS depth FROM (SELECT note, 0 AS depth FROM {{export_editions}} WHERE edition_id = 1 UNION ALL SELECT b.note, 1 FROM {_E} a JOIN {_E} b ON a.country = b.country WHERE a.edition_id = 1 UNION ALL SELECT c.note, 2 FROM {_E} a JOIN {_E} b ON a.country = b.country JOIN (SELECT DISTINCT note, title FROM {{export_editions}}) t ON t.title = b.title JOIN (SELECT DISTINCT note, title FROM {{export_editions}}) c ON c.title = t.title WHERE a.edition_id = 1) x GROUP BY note")

_DUCK = {
    "heading_index": lambda s: s.replace("'[^a-z0-9]', '')", "'[^a-z0-9]', '', 'g')"),
    "marked_titles": lambda s: s.replace("'<$1>')", r"'<\1>', 'g')"),
    "formatted_citations": lambda s: s.replace("AS STRING", "AS VARCHAR"),
    "structure_counts": lambda s: s,
}


def _dialects() -> None:
    from palimpsest.plans.registry import SQL

    for k, f in _DUCK.items():
        SQL[k] = f(SQL[k])


_dialects()

_FILES = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('%PDF-1.7 ', coalesce(text, ''), ' %%EOF') WHEN 1 THEN concat('%PDF-1.4 ', coalesce(text, '')) WHEN 2 THEN coalesce(text, '') ELSE '' END AS d FROM {documents}"


@query("F-11", "SELECT doc_id, CASE WHEN d = '' THEN 'empty' WHEN instr(substr(d, 1, 1024), '%PDF-') = 0 THEN 'no header' WHEN instr(right(d, 1024), '%%EOF') = 0 THEN 'truncated' END AS problem FROM (" + _FILES.format(documents="documents") + ")")
def pdf_problems(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with a file that should be a PDF, by its first and last bytes; documents stand in for files."""
    d = F.col("d")
    p = F.when(d == "", "empty").when(F.instr(F.substring(d, 1, 1024), F.lit("%PDF-")) == 0, "no header").when(F.instr(F.right(d, F.lit(1024)), F.lit("%%EOF")) == 0, "truncated")
    return spark.sql(_FILES, documents=table(spark, sf, "documents")).select("doc_id", p.alias("problem"))


_HEAD = "SELECT edition_id, note, first_seen, unnest(regexp_extract_all(coalesce(body, ''), '<h2[^>]*>([^<]*)</h2>', 1)) AS heading FROM (SELECT DISTINCT ON (edition_id) * FROM export_editions)"
_SLUG = "trim(regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g'), '-')"


@query("J-22", f"""
WITH h AS (SELECT edition_id, note, {_SLUG} AS slug FROM ({_HEAD})), t AS (SELECT DISTINCT note, slug FROM h), o AS (SELECT title_id, {_SLUG.replace('heading', 'topic')} AS slug FROM official_titles),
s AS (SELECT slug, min(title_id) AS title_id FROM o GROUP BY 1), p AS (SELECT k.slug, min(o.title_id) AS title_id FROM (SELECT DISTINCT slug FROM t) k JOIN o ON length(k.slug) >= 6 AND starts_with(o.slug, k.slug) GROUP BY 1)
SELECT t.note, t.slug, coalesce(s.title_id, p.title_id) AS target, CASE WHEN s.title_id IS NOT NULL THEN 'exact' WHEN p.title_id IS NOT NULL THEN 'prefix' END AS by FROM t LEFT JOIN s ON s.slug = t.slug LEFT JOIN p ON p.slug = t.slug""")
def resolved_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Headings looked up among the topics: by the whole slug, else the first that begins with it, if it has six characters.

    The prefix step is an equi-join of distinct slugs on six characters; what begins otherwise falls away behind it.
    """
    slug = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    e = table(spark, sf, "export_editions").dropDuplicates(["edition_id"])
    t = e.select("note", F.explode(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit("<h2[^>]*>([^<]*)</h2>"), F.lit(1))).alias("heading")).select("note", slug(F.col("heading")).alias("slug")).distinct()
    o = table(spark, sf, "official_titles").select("title_id", slug(F.col("topic")).alias("os"))
    s = o.groupBy("os").agg(F.min("title_id").alias("s"))
    head = lambda c: F.substring(c, 1, 6)
    k = t.where(F.length("slug") >= 6).select(F.col("slug").alias("ks")).distinct().join(o.select(F.col("os").alias("po"), "title_id"), head(F.col("ks")) == head(F.col("po")))
    p = k.where(F.col("po").startswith(F.col("ks"))).groupBy("ks").agg(F.min("title_id").alias("p"))
    j = t.join(s, F.col("slug") == F.col("os"), "left").join(p, F.col("slug") == F.col("ks"), "left")
    return j.select("note", "slug", F.coalesce("s", "p").alias("target"), F.when(F.col("s").isNotNull(), "exact").when(F.col("p").isNotNull(), "prefix").alias("by"))


_TOPIC = "SELECT title_id, country, list_distinct(regexp_extract_all(lower(topic), '[a-z0-9]+')) AS ws FROM official_titles"


@query("S-09 X-12 X-11", f"""
WITH t AS ({_TOPIC}), n AS (SELECT DISTINCT log_id, country, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) AS ws FROM title_log WHERE title IS NOT NULL),
m AS (SELECT n.log_id, t.title_id, len(list_intersect(t.ws, n.ws)) / len(t.ws) AS share, len(t.ws) AS size FROM n JOIN t ON t.country = n.country),
k AS (SELECT * FROM m WHERE share >= 0.6)
SELECT log_id, arg_max(title_id, (share, size, -title_id)) AS title_id, count(*) AS candidates FROM k GROUP BY log_id""")
def attributed_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Readings attributed to the topic of their country that their words explain best: at least 0.6 of its words, the fullest, the longest.

    Words are exploded and counted, so a country with very many topics costs its matches, not all pairs.
    """
    word = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    t = table(spark, sf, "official_titles").select("title_id", "country", word(F.col("topic")).alias("ws")).select("title_id", "country", F.size("ws").alias("size"), F.explode("ws").alias("w"))
    n = table(spark, sf, "title_log").where("title IS NOT NULL").select("log_id", "country", "title").distinct().select("log_id", "country", F.explode(word(F.col("title"))).alias("w"))
    m = n.join(t, ["country", "w"]).groupBy("log_id", "title_id", "size").agg(F.count("*").alias("c")).withColumn("share", F.col("c") / F.col("size")).where("share >= 0.6")
    return m.groupBy("log_id").agg(F.max_by("title_id", F.struct("share", "size", -F.col("title_id"))).alias("title_id"), F.count("*").alias("candidates"))


_NUM = "regexp_extract(line, '^\\s*(\\d+(?:\\.\\d+)+)\\s', 1)"


@query("W-11 M-35 M-41", f"""
WITH l AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '\\r?\\n') AS ls FROM documents), x AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM l), n AS (SELECT doc_id, pos, {_NUM} AS number FROM x WHERE {_NUM} <> '')
SELECT doc_id, pos, number, lag(number) OVER w AS before, lead(number) OVER w AS after, count(*) OVER (PARTITION BY doc_id, number) > 1 AS used_twice, len(string_split(number, '.')) AS depth FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""")
def paragraph_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers at the beginning of lines with their neighbours, depth and repetition."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("pos", "line"))
    n = d.select("doc_id", F.col("pos").cast("long").alias("pos"), F.regexp_extract("line", r"^\s*(\d+(?:\.\d+)+)\s", 1).alias("number")).where("number <> ''")
    w = Window.partitionBy("doc_id").orderBy("pos")
    return n.select("doc_id", "pos", "number", F.lag("number").over(w).alias("before"), F.lead("number").over(w).alias("after"), (F.count("*").over(Window.partitionBy("doc_id", "number")) > 1).alias("used_twice"), F.size(F.split("number", r"\.")).cast("long").alias("depth"))


@query("CMP-19 A-09", """
WITH s AS (SELECT source, n_chars AS v FROM documents WHERE n_chars IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM s)
SELECT source, max(n) AS documents, max(CASE WHEN i = CAST(floor(n * 0.5) AS BIGINT) THEN v END) AS median, max(CASE WHEN i = least(CAST(floor(n * 0.9) AS BIGINT), n - 1) THEN v END) AS tenth, max(v) AS most, count(*) FILTER (v > 5000) AS long_ones FROM r GROUP BY source""")
def length_table(spark: SparkSession, sf: str) -> DataFrame:
    """The standard table of a measure: rank quantiles and counts over a threshold."""
    s = table(spark, sf, "documents").where("n_chars IS NOT NULL").select("source", F.col("n_chars").alias("v"))
    q = R.rank_quantiles(s, ["source"], "v", {"median": 0.5, "tenth": 0.9}).withColumnRenamed("source", "s")
    n = s.groupBy("source").agg(F.count("*").alias("documents"), F.max("v").alias("most"), F.count_if(F.col("v") > 5000).alias("long_ones"))
    return n.join(q, F.col("source").eqNullSafe(F.col("s"))).select("source", "documents", "median", "tenth", "most", "long_ones")


@query("CMP-04 CMP-03 CMP-14", "SELECT doc_id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS plain, (SELECT count(*) FROM (SELECT unnest(regexp_extract_all(lower(coalesce(t, '')), '[^a-z]of the[^a-z]')))) AS raw FROM (SELECT doc_id, text AS t, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents)")
def run_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences of a run of words, overlapping ones too, in two readings: words, and the raw text."""
    d = table(spark, sf, "documents")
    hits = bound(words(F.col("text")), lambda w: F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: (F.try_element_at(w, i) == "of") & (F.try_element_at(w, i + 1) == "the"))))
    return d.select("doc_id", hits.cast("long").alias("plain"), F.size(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[^a-z]of the[^a-z]"), F.lit(0))).cast("long").alias("raw"))


@query("M-13 M-10", f"SELECT country, count(*) AS files FROM (SELECT DISTINCT e.country, c.capture_id FROM (SELECT DISTINCT ON (edition_id) * FROM export_editions) e JOIN captures c ON c.edition_id = e.edition_id WHERE e.source <> 'live' AND c.provider IS NOT NULL) GROUP BY country")
def catalogue_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """A nested catalogue (country, editions, captures) taken apart again with conditions on each level."""
    e = table(spark, sf, "export_editions").dropDuplicates(["edition_id"]).select("edition_id", "country", "source")
    c = table(spark, sf, "captures").dropDuplicates(["capture_id"]).groupBy("edition_id").agg(F.collect_list(F.struct("capture_id", "provider")).alias("files"))
    nested = e.join(c, "edition_id").select("country", F.struct("source", "files").alias("edition"))
    flat = nested.where("edition.source <> 'live'").select("country", F.explode("edition.files").alias("f")).where("f.provider IS NOT NULL")
    return flat.groupBy("country").agg(F.count("*").alias("files"))


@query("X-22 rule-38 rule-54")
def figures_in_words(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers written as words or with separators, as digits, counted by document (tested on their own)."""
    d = table(spark, sf, "documents").select("doc_id", N.plain_figures(F.coalesce("text", F.lit(""))).alias("t"))
    return d.select("doc_id", F.size(F.regexp_extract_all("t", F.lit(r"\d+(?:\.\d+)?"), F.lit(0))).cast("long").alias("figures"))


@query("W-15 X-32")
def located_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Quotations of each document found again in the document before, where their context agrees best (tested on its own)."""
    d = beside_previous(table(spark, sf, "documents").select("doc_id", "source", "text"), "source", ["doc_id"], "doc_id", ["text"])
    return N.locate_quotes(d, "doc_id", "text", "previous_text")
