"""Queries on plain text: fingerprints, phrases, normalisers, dates, quotations, checks of figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators.editions import collapse_copies as collapse
from palimpsest.operators.editions import similarity_to_previous as similarity
from palimpsest.operators.neighbours import beside_previous
from palimpsest.plans.registry import query
from palimpsest.session import once, table

_UNSEEN = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}\x{21a9}\x{fe0e}\x{fe0f}]+"
_SPACE = r"[\s\p{Z}]+"
_W = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
_GRAMS = "CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END"
_SIMILARITY = f"""
WITH d AS (SELECT doc_id, source, {_W} AS w FROM documents), g AS (SELECT doc_id, source, {_GRAMS} AS g FROM d),
p AS (SELECT doc_id, source, g, lag(g) OVER (PARTITION BY source ORDER BY doc_id) AS b, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS previous FROM g)
SELECT doc_id, source, previous, CASE WHEN previous IS NULL THEN NULL WHEN greatest(len(g), len(b)) = 0 THEN 1.0 ELSE round(len(list_intersect(g, b)) / greatest(len(g), len(b)), 3) END AS similarity FROM p"""


@query("X-02 X-03", f"SELECT doc_id, sha256(regexp_replace(text, '{_UNSEEN}', '', 'g')) AS text_sha, sha256(text) AS body_sha FROM documents")
def text_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("text_sha"), F.sha2("text", 256).alias("body_sha"))


@query("X-02 ST-01 A-24", f"SELECT sha256(regexp_replace(text, '{_UNSEEN}', '', 'g')) AS text_sha, count(*) AS copies, min(doc_id) AS first_doc, count(DISTINCT source) AS sources FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_and_text_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "source", T.fingerprint(F.col("text")).alias("text_sha"))
    return d.groupBy("text_sha").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"), F.countDistinct("source").alias("sources")).where("copies > 1")


@query("X-10 X-15 CMP-02", f"SELECT doc_id, len({_W}) AS n_words, len(list_distinct({_W})) AS n_distinct FROM documents")
def body_words(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "documents").select("doc_id", T.words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@query("X-10", f"SELECT doc_id, len({_GRAMS}) AS phrases FROM (SELECT doc_id, {_W} AS w FROM documents)")
def shingle_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(T.grams(T.words(F.col("text")), 5)).cast("long").alias("phrases"))


@query("W-01 S-01 M-32 M-55 ST-18", _SIMILARITY)
def similarity_to_previous(spark: SparkSession, sf: str) -> DataFrame:
    return similarity(table(spark, sf, "documents"), "source", "doc_id", "text")


@query("F-22 W-01", f"SELECT source, count(*) AS documents, count(*) FILTER (similarity < 0.25) AS rewrites, count(*) FILTER (similarity >= 0.9) AS kept FROM ({_SIMILARITY}) GROUP BY source")
def rewrite_flags(spark: SparkSession, sf: str) -> DataFrame:
    s = similarity(table(spark, sf, "documents"), "source", "doc_id", "text")
    return s.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("similarity") < 0.25).alias("rewrites"), F.count_if(F.col("similarity") >= 0.9).alias("kept"))


@query("W-02 W-03", f"""
WITH d AS (SELECT source, doc_id, lang, sha256(regexp_replace(coalesce(text, ''), '{_UNSEEN}', '', 'g')) AS h FROM documents),
f AS (SELECT *, CASE WHEN h = lag(h) OVER w THEN 0 ELSE 1 END AS new FROM d WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY doc_id) AS run FROM f)
SELECT source, arg_max(doc_id, (CASE WHEN lang = 'en' THEN 1 ELSE 0 END, -doc_id)) AS kept, min(doc_id) AS first_doc, count(*) AS copies FROM r GROUP BY source, run""")
def collapse_consecutive_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Adjacent documents of a series with one text are one edition; an English copy is preferred, then the earlier."""
    d = table(spark, sf, "documents").withColumn("h", T.fingerprint(F.coalesce("text", F.lit(""))))
    rank = F.struct((F.coalesce(F.col("lang") == "en", F.lit(False))).cast("int"), -F.col("doc_id"))
    return collapse(d, "source", "doc_id", "h", rank)


@query("X-19 X-27 M-19", f"""
SELECT edition_id, lower(trim(regexp_replace(translate(title, '‘’“”­', '''''""'), '{_SPACE}', ' ', 'g'))) AS quotation, trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS key,
  trim(regexp_replace(regexp_replace(replace(lower(title), '&', ' and '), '[^\\p{{L}}\\p{{N}}\\- ]+', ' ', 'g'), '{_SPACE}', ' ', 'g')) AS topic,
  lower(trim(regexp_replace(regexp_replace(regexp_replace(title, '^\\s*\\d+(?:\\.\\d+)*\\.?\\s+', ''), '[\\s:.;]+$', ''), '{_SPACE}', ' ', 'g'))) AS heading
FROM (SELECT DISTINCT edition_id, title FROM export_editions)""")
def normalised_titles(spark: SparkSession, sf: str) -> DataFrame:
    e, t = table(spark, sf, "export_editions").select("edition_id", "title").distinct(), F.col("title")
    return e.select("edition_id", T.normal_quotation(t).alias("quotation"), T.normal_key(t).alias("key"), T.normal_topic(t).alias("topic"), T.normal_heading(t).alias("heading"))


_D = r"(?i)\b(\d{1,2}\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4})\b"
_DATES = f"SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{_D}', 1)) AS written FROM documents"
_ISO = "try_strptime(regexp_replace(written, '\\s+', ' ', 'g'), '%d %B %Y')"


@query("X-05 rule-17 rule-24", f"SELECT doc_id, written, strftime({_ISO}, '%Y-%m-%d') AS day FROM ({_DATES})")
def dates_in_text(spark: SparkSession, sf: str) -> DataFrame:
    """Every English date in the documents; an impossible one has no day (invalid-calendar-date)."""
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_D), F.lit(1))).alias("written"))
    return d.select("doc_id", "written", T.english_date(F.col("written")).alias("day"))


@query("X-06", "SELECT capture_id, strftime(try_strptime(rpad(captured_at, 14, '0'), '%Y%m%d%H%M%S'), '%Y-%m-%dT%H:%M:%SZ') AS at FROM (SELECT DISTINCT capture_id, captured_at FROM captures) WHERE regexp_full_match(captured_at, '\\d{8}|\\d{12}|\\d{14}')")
def digit_stamps(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "captures").select("capture_id", "captured_at").distinct().where(F.col("captured_at").rlike(r"^(?:\d{8}|\d{12}|\d{14})\z"))
    return c.select("capture_id", F.date_format(F.try_to_timestamp(F.rpad("captured_at", 14, "0"), F.lit("yyyyMMddHHmmss")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))


_T = "trim(regexp_replace(coalesce(text, ''), '(?i)\\[footnote\\s+\\d+\\]', '', 'g'))"
_WHOLE = f"regexp_extract({_T}, '(?s)^(?:“(.+)”|‘(.+)’)', 0)"
_Q = f"list_filter(list_transform(CASE WHEN {_WHOLE} <> '' THEN [{_WHOLE}] ELSE regexp_extract_all({_T}, '{T.QUOTED}') END, lambda q: substr(q, 2, length(q) - 2)), lambda q: len(regexp_split_to_array(trim(q), '\\s+')) BETWEEN 8 AND 300)"


@query("X-21 rule-31", f"SELECT doc_id, len(list_distinct({_Q})) AS quotations FROM documents")
def quotations(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct quotations of eight to three hundred words in each document, whatever marks they stand in."""
    return table(spark, sf, "documents").select("doc_id", F.size(T.quotations(F.col("text"), first=1_000_000)).cast("long").alias("quotations"))


_HEADS = r"list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(body, ''), '(?is)<h[1-6][^>]*>(.*?)</h[1-6]\s*>', 1), lambda h: lower(trim(regexp_replace(regexp_replace(h, '<[^>]*>', '', 'g'), '[\s\p{Z}]+', ' ', 'g')))), lambda h: h <> '' AND len(string_split_regex(h, '\s+')) <= 14))".replace("\\", "\\")
_NOTE_REF = T.NOTE_REF.replace("'", "''")


@query("MEC-03 MEC-04 MEC-05 MEC-07 MEC-15", f"SELECT edition_id, len({_HEADS}) AS headings, len(regexp_extract_all(coalesce(body, ''), '{_NOTE_REF}')) AS note_marks, regexp_matches(regexp_replace(coalesce(body, ''), '{_NOTE_REF}', ' ', 'g'), '(?i)\\[footnote') AS marks_left FROM (SELECT DISTINCT ON (edition_id) * FROM export_editions)")
def comparison_texts(spark: SparkSession, sf: str) -> DataFrame:
    """What is left out of a body before quotations are compared: headings that stand once, marks of notes."""
    e = once(table(spark, sf, "export_editions").select("edition_id", "body"), "edition_id")
    body = F.coalesce("body", F.lit(""))
    return e.select("edition_id", F.size(T.headings(F.col("body"))).cast("long").alias("headings"), F.size(F.regexp_extract_all(body, F.lit(T.NOTE_REF), F.lit(0))).cast("long").alias("note_marks"), T.without_notes(F.col("body")).rlike(r"(?i)\[footnote").alias("marks_left"))


@query("X-25 X-11", "SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '(?i)\\bparagraphs?\\s+(\\d+(?:\\.\\d+)*)', 1)) AS paragraph FROM documents")
def paragraph_references(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?i)\bparagraphs?\s+(\d+(?:\.\d+)*)"), F.lit(1))).alias("paragraph"))


_LINE = "SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\\r?\\n')) AS line FROM documents WHERE kind = 'footnotes'"
_CITE = "regexp_extract(line, '^\\s*\\d+\\.\\s+(.*)$', 1)"


@query("X-20 M-23", f"""
SELECT doc_id, trim(string_split(cite, ',')[1]) AS publisher, nullif(regexp_extract(cite, '‘([^’]+)’', 1), '') AS title, nullif(regexp_extract(split_part(cite, 'accessed', 1), '(\\d{{1,2}} [A-Z][a-z]+ \\d{{4}})', 1), '') AS published,
  nullif(regexp_extract(cite, '(https?://\\S+[^\\s,.;)])', 1), '') AS url, contains(cite, 'accessed') AS has_access
FROM (SELECT doc_id, {_CITE} AS cite FROM ({_LINE})) WHERE cite <> ''""")
def citations(spark: SparkSession, sf: str) -> DataFrame:
    """Footnotes taken apart: publisher, title, date, address."""
    d = table(spark, sf, "documents").where("kind = 'footnotes'").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("line"))
    d = d.select("doc_id", F.regexp_extract("line", r"^\s*\d+\.\s+(.*)$", 1).alias("cite")).where("cite <> ''")
    part = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    cite = F.col("cite")
    return d.select("doc_id", F.trim(F.split("cite", ",")[0]).alias("publisher"), part(cite, "‘([^’]+)’").alias("title"), part(F.substring_index("cite", "accessed", 1), r"(\d{1,2} [A-Z][a-z]+ \d{4})").alias("published"), part(cite, r"(https?://\S+[^\s,.;)])").alias("url"), F.contains(cite, F.lit("accessed")).alias("has_access"))


@query("X-31", "SELECT doc_id, strftime((loaded_at AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/London', '%Y-%m-%d %H:%M') AS london FROM documents")
def london_time(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("Europe/London"), F.col("loaded_at").cast("timestamp_ntz")), "yyyy-MM-dd HH:mm").alias("london"))


@query("X-24 CMP-13")
def title_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Edit distance of an edition's title to the one before it, 9 if the lengths are far apart."""
    t = table(spark, sf, "export_editions").select("edition_id", "note", "title", "first_seen").distinct().where("title IS NOT NULL")
    p = t.withColumn("before", F.lag("title").over(Window.partitionBy("note").orderBy("first_seen", "edition_id"))).where("before IS NOT NULL")
    far = F.abs(F.length("title") - F.length("before")) > 3
    return p.select("edition_id", F.when(far, 9).otherwise(F.least(F.levenshtein("title", "before"), F.lit(9))).cast("long").alias("edits"))


@query("X-34 X-01")
def visible_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Visible text of every edition, entities decoded; checked against the table's own hash in the tests."""
    e = table(spark, sf, "export_editions").select("edition_id", "body").dropDuplicates(["edition_id"])
    return e.select("edition_id", T.visible_text(F.col("body")).alias("text"))


@query("X-04")
def version_banners(spark: SparkSession, sf: str) -> DataFrame:
    """The version each edition states; checked against the column version_banner in the tests."""
    e = table(spark, sf, "export_editions").select("edition_id", "body").dropDuplicates(["edition_id"])
    return e.select("edition_id", T.version_banner(T.visible_text(F.col("body"))).alias("version"))


@query("X-16 MEC-01 CMP-29", f"""
WITH d AS (SELECT doc_id, source, {_W} AS w, text FROM documents), h AS (SELECT doc_id, source, text, ' ' || array_to_string(w, ' ') || ' ' AS flat FROM d),
p AS (SELECT doc_id, text, lag(flat) OVER (PARTITION BY source ORDER BY doc_id) AS other FROM h),
s AS (SELECT doc_id, other, unnest(string_split_regex(coalesce(text, ''), '[.!?]\\s+')) AS sentence FROM p WHERE other IS NOT NULL),
v AS (SELECT doc_id, other, regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}]+') AS sw FROM s)
SELECT doc_id, count(*) AS sentences, count(*) FILTER (contains(other, ' ' || array_to_string(sw, ' ') || ' ')) AS found FROM v WHERE len(sw) >= 8 GROUP BY doc_id""")
def sentence_containment(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of eight or more words that stand word for word in the document before."""
    d = table(spark, sf, "documents").select("doc_id", "source", "text", F.concat(F.lit(" "), F.array_join(T.words(F.col("text")), " "), F.lit(" ")).alias("flat"))
    d = beside_previous(d, "source", ["doc_id"], "doc_id", ["text", "flat"]).where("previous IS NOT NULL").select("doc_id", "text", F.col("previous_flat").alias("other"))
    # a sentence is looked up in its own row: the other text isn't repeated for each sentence
    spoken = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"[.!?]\s+"), lambda s: F.array_join(T.words(s), " ")), lambda s: F.size(F.split(s, " ")) >= 8)
    s = d.select("doc_id", "other", spoken.alias("s")).where(F.size("s") > 0)
    hits = F.filter("s", lambda x: F.contains(F.col("other"), F.concat(F.lit(" "), x, F.lit(" "))))
    return s.select("doc_id", F.size("s").cast("long").alias("sentences"), F.size(hits).cast("long").alias("found"))
