"""Queries on series of editions: dates, titles, currency, captures, timelines, summaries, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import titles as N
from palimpsest.operators import editions as E
from palimpsest.operators import instants as I
from palimpsest.operators import relational as R
from palimpsest.operators import state as S
from palimpsest.plans.registry import query
from palimpsest.session import table

DAY = 86_400_000_000


def editions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "export_editions").dropDuplicates(["edition_id"])


_E = "(SELECT DISTINCT ON (edition_id) * FROM export_editions)"
_M = "January|February|March|April|May|June|July|August|September|October|November|December"
_T = rf"trim(regexp_replace(title, '[\s\p{{Z}}]+', ' ', 'g'))"
_PARSE = rf"""
WITH a AS (SELECT edition_id, country, regexp_replace({_T}, '(?i)\s*\((?:large print|accessible|accesible|accessible version)\)\s*$', '') AS t, regexp_matches({_T}, '(?i)\s*\((?:large print|accessible|accesible|accessible version)\)\s*$') AS accessible FROM {_E} WHERE title IS NOT NULL),
b AS (SELECT *, regexp_extract(t, '(?i)[,\s]\s*({_M})\s+(\d{{4}})\s*$', 1) AS m, regexp_extract(t, '(?i)[,\s]\s*({_M})\s+(\d{{4}})\s*$', 2) AS y, regexp_replace(regexp_replace(t, '(?i)[,\s]\s*({_M})\s+(\d{{4}})\s*$', ''), '[ ,]+$', '') AS u FROM a),
c AS (SELECT *, ends_with(lower(u), lower(country)) AS names_country FROM b),
d AS (SELECT *, CASE WHEN names_country THEN regexp_replace(substr(u, 1, length(u) - length(country)), '[ ,]+$', '') ELSE u END AS r FROM c)
SELECT edition_id, CASE WHEN contains(r, ':') THEN lower(trim(split_part(r, ':', 1))) ELSE '' END AS kind, trim(CASE WHEN contains(r, ':') THEN substr(r, instr(r, ':') + 1) ELSE r END) AS topic,
  CASE WHEN m <> '' THEN y || '-' || lpad(CAST((instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(substr(m, 1, 3))) + 2) // 3 AS VARCHAR), 2, '0') END AS month, accessible, names_country FROM d"""


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    e = editions(spark, sf).where("title IS NOT NULL")
    return e.select("edition_id", "country", "note", "source", *[c.alias(k) for k, c in N.parse_title(F.col("title"), F.col("country")).items()])


@query("X-07 M-34 X-35", _PARSE)
def title_parse(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(spark, sf).drop("country", "note", "source")


_WORDS = "list_filter(regexp_extract_all(lower(replace(topic, '&', ' and ')), '[\\p{L}\\p{N}]+'), lambda w: w NOT IN ('" + "', '".join(N.FILLER) + "'))"
_CORE = f"array_to_string(list_sort(list_distinct({_WORDS})), '-')"
_KEY = f"CASE WHEN contains(kind, 'bulletin') THEN 'bulletin' WHEN contains(kind, 'fact-finding') THEN 'fact-finding' ELSE 'note' END || ':' || CASE WHEN {_CORE} = '' THEN 'untitled' ELSE {_CORE} END"


@query("X-08 A-15", f"SELECT CASE k WHEN 'note:debt-disputes' THEN 'note:debt-disputes-lending' ELSE k END AS series, count(*) AS editions FROM (SELECT {_KEY} AS k FROM ({_PARSE})) GROUP BY 1")
def series_grouping(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(spark, sf).groupBy(N.series_key(F.col("kind"), F.col("topic")).alias("series")).agg(F.count("*").alias("editions"))


@query("F-05", f"SELECT CASE WHEN contains(kind, 'information summary') THEN 'Summary' WHEN contains(kind, 'conditions note') THEN 'Conditions' WHEN contains(kind, 'situation note') THEN 'Situation' WHEN contains(kind, 'bulletin') THEN 'Bulletin' WHEN kind = '' THEN 'Notice' ELSE upper(substr(kind, 1, 1)) || substr(kind, 2) END AS label, count(*) AS editions FROM ({_PARSE}) GROUP BY 1")
def kind_labels(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(spark, sf).groupBy(N.kind_label(F.col("kind")).alias("label")).agg(F.count("*").alias("editions"))


@query("X-09", "SELECT DISTINCT note, replace(regexp_replace(note, '-[0-9a-f]{1,4}$', ''), '-', ' ') AS words FROM export_editions")
def slug_titles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "export_editions").select("note").distinct().select("note", N.title_from_slug(F.col("note")).alias("words"))


@query("F-06 F-07 M-31", f"""
SELECT e.edition_id, CASE WHEN month IS NOT NULL THEN month || '-01' ELSE strftime(first_seen, '%Y-%m-%d') END AS dated, CASE WHEN month IS NOT NULL THEN 'month' ELSE 'day' END AS precision, CASE WHEN month IS NOT NULL THEN 'title' ELSE 'first seen' END AS dated_from
FROM {_E} e LEFT JOIN ({_PARSE}) p ON p.edition_id = e.edition_id""")
def own_dates(spark: SparkSession, sf: str) -> DataFrame:
    """An edition's date by its own account: the month in its title, else the day it was first seen; with precision and provenance."""
    e = editions(spark, sf)
    m = N.parse_title(F.col("title"), F.col("country"))["month"]
    e = e.select("edition_id", "first_seen", m.alias("month"))
    own = F.col("month").isNotNull()
    return e.select("edition_id", F.when(own, F.concat("month", F.lit("-01"))).otherwise(F.date_format("first_seen", "yyyy-MM-dd")).alias("dated"), F.when(own, "month").otherwise("day").alias("precision"), F.when(own, "title").otherwise("first seen").alias("dated_from"))


@query("W-04 F-21", f"SELECT edition_id, CASE WHEN source = 'live' THEN min(CASE WHEN source = 'live' THEN first_seen END) OVER (PARTITION BY note ORDER BY first_seen, edition_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) END AS left_at FROM {_E}")
def left_the_source(spark: SparkSession, sf: str) -> DataFrame:
    return E.left_source(editions(spark, sf), "note", "edition_id", "first_seen", F.col("source") == "live").select("edition_id", "left_at")


@query("W-05 M-40 M-04 F-24", f"SELECT note, arg_max(edition_id, (CASE WHEN source = 'live' THEN 1 ELSE 0 END, first_seen, edition_id)) AS edition_id, count(*) AS editions FROM {_E} GROUP BY note")
def current_edition(spark: SparkSession, sf: str) -> DataFrame:
    """A note's edition to read: the last live one, else the last."""
    rank = F.struct((F.col("source") == "live").cast("int"), "first_seen", "edition_id")
    return editions(spark, sf).groupBy("note").agg(F.max_by("edition_id", rank).alias("edition_id"), F.count("*").alias("editions"))


_C = "(SELECT DISTINCT ON (capture_id) * FROM captures)"


@query("A-24 A-25 A-26 ST-01", f"SELECT edition_id, count(*) AS captures, min(capture_id) AS first_capture, max(capture_id) AS last_capture, count(DISTINCT provider) AS providers, arg_min(archive_url, capture_id) AS first_url, count(DISTINCT digest) AS digests FROM {_C} GROUP BY edition_id")
def merged_captures(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "captures").dropDuplicates(["capture_id"])
    return c.groupBy("edition_id").agg(F.count("*").alias("captures"), F.min("capture_id").alias("first_capture"), F.max("capture_id").alias("last_capture"), F.countDistinct("provider").alias("providers"), F.min_by("archive_url", "capture_id").alias("first_url"), F.countDistinct("digest").alias("digests"))


@query("M-03 W-10", f"SELECT edition_id, capture_id, row_number() OVER (PARTITION BY edition_id ORDER BY capture_id) AS place, lag(digest) OVER (PARTITION BY edition_id ORDER BY capture_id) AS previous FROM {_C}")
def capture_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Every capture with its place and the digest before it: the history of an asset as rows."""
    c, w = table(spark, sf, "captures").dropDuplicates(["capture_id"]), Window.partitionBy("edition_id").orderBy("capture_id")
    return c.select("edition_id", "capture_id", F.row_number().over(w).cast("long").alias("place"), F.lag("digest").over(w).alias("previous"))


_CAP = f"(SELECT capture_id, edition_id, epoch_us(TRY_CAST(captured_at AS TIMESTAMPTZ)) AS t FROM {_C} WHERE regexp_full_match(captured_at, '\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\dZ') AND TRY_CAST(captured_at AS TIMESTAMPTZ) IS NOT NULL)"


def exact_captures(spark: SparkSession, sf: str) -> DataFrame:
    """Captures with an exact stamp (`dated_captures` has those of any writing)."""
    c = table(spark, sf, "captures").dropDuplicates(["capture_id"]).where(F.col("captured_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\z"))
    return c.select("capture_id", "edition_id", F.unix_micros(F.col("captured_at").try_cast("timestamp")).alias("t")).where("t IS NOT NULL")


def dated(spark: SparkSession, sf: str, name: str, stamp: str, key: str, *keep: str) -> DataFrame:
    """`key`, `keep` and `t` of the rows whose stamp denotes an instant, in any writing, by the zone and day order of their provider."""
    sources = table(spark, sf, "stamp_sources")
    src = sources.groupBy("provider").agg(F.min(F.struct("zone", "day_first")).alias("s"))
    rows = table(spark, sf, name).select(key, *keep, stamp, "provider").join(src, "provider", "left")
    found = I.with_instant(rows, stamp, F.col("s.zone"), F.col("s.day_first"), "t", I.listed_zones(sources))
    return found.where("t IS NOT NULL").select(key, *keep, "t").dropDuplicates([key])


def dated_captures(spark: SparkSession, sf: str) -> DataFrame:
    return dated(spark, sf, "captures", "captured_at", "capture_id", "edition_id")


def hosts(captures: DataFrame, e: DataFrame) -> DataFrame:
    """Each capture with the edition that was the note's last one (three days' grace), attached if within 45 days."""
    start = e.select("note", "edition_id", F.unix_micros(F.col("first_seen").cast("timestamp")).alias("s"))
    u = captures.join(e.select("edition_id", "note"), "edition_id").select("capture_id", "note", "t", (F.col("t") + 3 * DAY).alias("late"))
    h = R.asof_join(u, start.withColumnRenamed("edition_id", "host"), ["note"], "late", "s", ["host"], 3650 * DAY)
    return h.select("capture_id", "host", F.coalesce(F.col("t") - F.col("s") <= 45 * DAY, F.lit(False)).alias("attached"))


def nearest(d: DataFrame, captures: DataFrame, e: DataFrame) -> DataFrame:
    """For each download (`download_id`, `note`, `t`) the capture of its note nearest in time, of several the first."""
    c = captures.join(e.select("edition_id", "note"), "edition_id").select("note", "capture_id", F.col("t").alias("ct"))
    # nearest before and nearest after: two as-of joins instead of all pairs of a note
    b = R.asof_join(d, c.groupBy("note", "ct").agg(F.min("capture_id").alias("cb")), ["note"], "t", "ct", ["cb"], 3650 * DAY).withColumnRenamed("ct", "tb")
    after = c.groupBy("note", "ct").agg(F.min("capture_id").alias("ca")).select("note", (-F.col("ct")).alias("nt"), "ca")
    j = R.asof_join(b.withColumn("minus", -F.col("t")), after, ["note"], "minus", "nt", ["ca"], 3650 * DAY)
    near = F.least(F.when(F.col("cb").isNotNull(), F.struct((F.col("t") - F.col("tb")).alias("d"), F.col("cb").alias("c"))), F.when(F.col("ca").isNotNull(), F.struct((-F.col("nt") - F.col("t")).alias("d"), F.col("ca").alias("c"))))
    return j.select("download_id", near.getField("c").alias("nearest")).where("nearest IS NOT NULL")


@query("J-05 J-06 W-07", f"""
WITH e AS (SELECT note, edition_id, epoch_us(first_seen) AS s FROM {_E}), u AS (SELECT c.capture_id, x.note, c.t FROM {_CAP} c JOIN {_E} x ON x.edition_id = c.edition_id),
h AS (SELECT u.capture_id, u.note, u.t, max((s, e.edition_id)) AS host FROM u LEFT JOIN e ON e.note = u.note AND e.s <= u.t + 259200000000 GROUP BY ALL)
SELECT capture_id, host[2] AS host, coalesce(t - host[1] <= 3888000000000, FALSE) AS attached FROM h""")
def timeline_hosts(spark: SparkSession, sf: str) -> DataFrame:
    """Of captures with an exact stamp, as the SQL has it; all others too: `dated_timeline_hosts`."""
    return hosts(exact_captures(spark, sf), editions(spark, sf))


@query("J-05 J-06 W-07")
def dated_timeline_hosts(spark: SparkSession, sf: str) -> DataFrame:
    """Every capture whose stamp denotes an instant, however written, with its host."""
    return hosts(dated_captures(spark, sf), editions(spark, sf))


@query("M-08", f"""
SELECT d.download_id, arg_min(c.capture_id, (abs(c.t - d.t), c.capture_id)) AS nearest FROM (SELECT DISTINCT ON (download_id) download_id, note, epoch_us(TRY_CAST(downloaded_at AS TIMESTAMPTZ)) AS t FROM repository_downloads WHERE regexp_full_match(downloaded_at, '\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\dZ')) d
JOIN {_E} e ON e.note = d.note JOIN {_CAP} c ON c.edition_id = e.edition_id GROUP BY d.download_id""")
def nearest_capture(spark: SparkSession, sf: str) -> DataFrame:
    """Of downloads and captures with an exact stamp, as the SQL has it; all others too: `dated_nearest_capture`."""
    d = table(spark, sf, "repository_downloads").dropDuplicates(["download_id"]).where(F.col("downloaded_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\z")).select("download_id", "note", F.unix_micros(F.col("downloaded_at").try_cast("timestamp")).alias("t")).where("t IS NOT NULL")
    return nearest(d, exact_captures(spark, sf), editions(spark, sf))


@query("M-08")
def dated_nearest_capture(spark: SparkSession, sf: str) -> DataFrame:
    """For each download whose stamp denotes an instant, however written, the capture of its note nearest in time."""
    d = dated(spark, sf, "repository_downloads", "downloaded_at", "download_id", "note")
    return nearest(d, dated_captures(spark, sf), editions(spark, sf))


@query("W-16 ST-19", "SELECT log_id, edition_id FROM (SELECT log_id, edition_id, title, public_updated_at, lag(title) OVER w AS bt, lag(public_updated_at) OVER w AS bp, row_number() OVER w AS i FROM (SELECT DISTINCT ON (log_id) * FROM title_log) WINDOW w AS (PARTITION BY edition_id ORDER BY received_at, log_id)) WHERE i = 1 OR title IS DISTINCT FROM bt OR public_updated_at IS DISTINCT FROM bp")
def title_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Readings, as received, that differ from the one received before."""
    return E.change_points(table(spark, sf, "title_log").dropDuplicates(["log_id"]), "edition_id", ["received_at", "log_id"], ["title", "public_updated_at"]).select("log_id", "edition_id")


@query("A-11 A-12 A-15 M-06 SNK-06", f"""
SELECT country, count(DISTINCT note) AS notes, count(*) AS editions, count(*) FILTER (source = 'live') AS live, count(*) FILTER (body IS NULL OR body = '') AS empty, min(first_seen) AS first_seen, arg_max(edition_id, (first_seen, edition_id)) AS newest, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes
FROM {_E} GROUP BY ROLLUP (country)""")
def country_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries of every country and, with a null country, of all."""
    e = editions(spark, sf)
    newest = F.max_by("edition_id", F.struct("first_seen", "edition_id"))
    return e.rollup("country").agg(F.countDistinct("note").alias("notes"), F.count("*").alias("editions"), F.count_if(F.col("source") == "live").alias("live"), F.count_if(F.coalesce(F.col("body") == "", F.lit(True))).alias("empty"), F.min("first_seen").alias("first_seen"), newest.alias("newest"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))


@query("O-01 O-02 SNK-12", f"SELECT edition_id, country, source, first_seen FROM {_E} ORDER BY source = 'live' DESC, first_seen DESC, edition_id LIMIT 60")
def recent_changes(spark: SparkSession, sf: str) -> DataFrame:
    return editions(spark, sf).select("edition_id", "country", "source", "first_seen").orderBy((F.col("source") == "live").desc(), F.desc("first_seen"), "edition_id").limit(60)


@query("J-10 M-12 S-10", f"SELECT d.download_id, e.edition_id AS held_as FROM (SELECT DISTINCT ON (download_id) * FROM repository_downloads) d JOIN (SELECT note, min(edition_id) AS edition_id FROM {_E} GROUP BY note) e ON e.note = d.note")
def held_elsewhere(spark: SparkSession, sf: str) -> DataFrame:
    """Downloads of notes that are held as editions; repeats point to the first."""
    e = editions(spark, sf).groupBy("note").agg(F.min("edition_id").alias("held_as"))
    return table(spark, sf, "repository_downloads").dropDuplicates(["download_id"]).join(e, "note").select("download_id", "held_as")


@query("A-03 A-04 M-18", f"SELECT country, count(*) AS editions, count(*) FILTER (body IS NOT NULL AND sha256(body) = sha256) AS ok, count(*) FILTER (body IS NOT NULL AND sha256(body) <> sha256) AS mismatches, count(*) FILTER (body IS NULL) AS missing FROM {_E} GROUP BY country")
def integrity(spark: SparkSession, sf: str) -> DataFrame:
    """Recomputed hashes of bodies against the delivered ones."""
    same = F.sha2("body", 256) == F.col("sha256")
    return editions(spark, sf).groupBy("country").agg(F.count("*").alias("editions"), F.count_if(same).alias("ok"), F.count_if(~same).alias("mismatches"), F.count_if(F.col("body").isNull()).alias("missing"))


@query("F-12 F-14 F-23", f"SELECT edition_id, CASE WHEN n IS NULL THEN 'uncaptured' WHEN known = 0 THEN 'unknown source' WHEN digests = 1 THEN 'one copy' ELSE 'several copies' END AS status FROM {_E} LEFT JOIN (SELECT edition_id AS e, count(*) AS n, count(provider) AS known, count(DISTINCT digest) AS digests FROM {_C} GROUP BY 1) ON e = edition_id")
def edition_status(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "captures").dropDuplicates(["capture_id"]).groupBy(F.col("edition_id").alias("e")).agg(F.count("*").alias("n"), F.count("provider").alias("known"), F.countDistinct("digest").alias("digests"))
    j = editions(spark, sf).join(c, F.col("e") == F.col("edition_id"), "left")
    return j.select("edition_id", F.when(F.col("n").isNull(), "uncaptured").when(F.col("known") == 0, "unknown source").when(F.col("digests") == 1, "one copy").otherwise("several copies").alias("status"))


@query("ST-01 ST-02", """
WITH r AS (SELECT snapshot_no, note, status, lower(text_sha256) AS h, row_number() OVER (PARTITION BY snapshot_no, note ORDER BY delivered_at DESC, text_sha256, first_seen, last_seen, status) AS i FROM note_snapshots),
o AS (SELECT note, snapshot_no, status, h, lag(h) OVER w AS bh, lag(status) OVER w AS bs, row_number() OVER w AS n FROM r WHERE i = 1 WINDOW w AS (PARTITION BY note ORDER BY snapshot_no)),
s AS (SELECT * FROM o WHERE n = 1 OR h IS DISTINCT FROM bh OR status IS DISTINCT FROM bs)
SELECT note, snapshot_no AS valid_from, lead(snapshot_no) OVER (PARTITION BY note ORDER BY snapshot_no) AS valid_to, status, h AS text_sha256 FROM s""")
def scd2_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Versions of each note by text and status with the snapshots between which they held."""
    n = table(spark, sf, "note_snapshots").withColumn("h", F.lower("text_sha256"))
    w = Window.partitionBy("snapshot_no", "note").orderBy(F.desc("delivered_at"), "text_sha256", "first_seen", "last_seen", "status")
    one = n.withColumn("i", F.row_number().over(w)).where("i = 1")
    s = E.change_points(one, "note", ["snapshot_no"], ["h", "status"])
    return s.select("note", F.col("snapshot_no").alias("valid_from"), F.lead("snapshot_no").over(Window.partitionBy("note").orderBy("snapshot_no")).alias("valid_to"), "status", F.col("h").alias("text_sha256"))


@query("ST-01 ST-05 ST-20", """
WITH old AS (SELECT note, max(delivered_at) AS d, nullif(max((delivered_at, lower(coalesce(text_sha256, ''))))[2], '') AS h FROM note_snapshots WHERE snapshot_no <= 6 GROUP BY note), new AS (SELECT note, max(delivered_at) AS d, nullif(max((delivered_at, lower(coalesce(text_sha256, ''))))[2], '') AS h FROM note_snapshots WHERE snapshot_no > 6 GROUP BY note)
SELECT coalesce(n.note, o.note) AS note, CASE WHEN o.note IS NULL THEN 'inserted' WHEN n.note IS NULL THEN 'kept' WHEN n.h IS DISTINCT FROM o.h THEN 'updated' ELSE 'seen' END AS action, greatest(coalesce(n.d, o.d), coalesce(o.d, n.d)) AS last_seen, CASE WHEN n.note IS NULL THEN o.h ELSE n.h END AS text_sha256 FROM old o FULL JOIN new n ON n.note = o.note""")
def merge_batch(spark: SparkSession, sf: str) -> DataFrame:
    """A batch merged into a stored state: inserted, updated, seen, kept. The batch wins, last_seen never goes back."""
    n = table(spark, sf, "note_snapshots").withColumn("h", F.lower("text_sha256"))
    old, new = n.where("snapshot_no <= 6"), n.where("snapshot_no > 6")
    return S.merge_batch(S.latest(old, "note", "delivered_at", "h"), S.latest(new, "note", "delivered_at", "h"), "note").select("note", "action", F.col("at").alias("last_seen"), F.col("value").alias("text_sha256"))


@query("ST-08 CMP-18", "SELECT count(DISTINCT sha256(coalesce(body, ''))) AS computations, count(DISTINCT edition_id) AS occurrences FROM export_editions")
def shared_computations(spark: SparkSession, sf: str) -> DataFrame:
    """Work shared by input hash: how many results serve how many occurrences."""
    return table(spark, sf, "export_editions").select(F.sha2(F.coalesce("body", F.lit("")), 256).alias("h"), "edition_id").agg(F.countDistinct("h").alias("computations"), F.countDistinct("edition_id").alias("occurrences"))


@query("J-27 J-28 M-15 M-22", """
SELECT 'capture without edition' AS problem, count(*) AS rows FROM captures c WHERE NOT EXISTS (SELECT 1 FROM export_editions e WHERE e.edition_id = c.edition_id)
UNION ALL SELECT 'reading without edition', count(*) FROM title_log c WHERE NOT EXISTS (SELECT 1 FROM export_editions e WHERE e.edition_id = c.edition_id)
UNION ALL SELECT 'saved without hash', count(*) FROM repository_downloads WHERE status = 'saved' AND sha256 IS NULL
UNION ALL SELECT 'malformed hash', count(*) FROM note_snapshots WHERE text_sha256 IS NOT NULL AND NOT regexp_full_match(text_sha256, '[0-9a-fA-F]{64}')
UNION ALL SELECT 'title not unique', count(*) FROM (SELECT title FROM official_titles GROUP BY title HAVING count(*) > 1)""")
def contract_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Checks of the input before anything is changed; any row above zero rejects a batch."""
    e = table(spark, sf, "export_editions").select("edition_id")
    t = lambda n: table(spark, sf, n)
    found = [
        ("capture without edition", t("captures").join(e, "edition_id", "left_anti")), ("reading without edition", t("title_log").join(e, "edition_id", "left_anti")),
        ("saved without hash", t("repository_downloads").where("status = 'saved' AND sha256 IS NULL")), ("malformed hash", t("note_snapshots").where(~F.col("text_sha256").rlike(r"^[0-9a-fA-F]{64}\z"))),
        ("title not unique", t("official_titles").groupBy("title").count().where("count > 1")),
    ]
    out = None
    for name, df in found:
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("problem"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("J-14 J-21", f"SELECT note, edition_id, place FROM (SELECT note, edition_id, row_number() OVER (PARTITION BY note ORDER BY edition_id) AS place FROM {_E} e WHERE NOT EXISTS (SELECT 1 FROM repository_downloads d WHERE d.note = e.note)) WHERE place <= 2")
def not_downloaded(spark: SparkSession, sf: str) -> DataFrame:
    """Editions of notes that no download knows, at most two a note."""
    d = table(spark, sf, "repository_downloads").select("note").distinct()
    return R.top_k_with_overflow(editions(spark, sf).join(d, "note", "left_anti"), ["note"], [F.col("edition_id")], 2).select("note", "edition_id", F.col("place").cast("long").alias("place"))


@query("M-17 M-51", f"SELECT edition_id, note || CASE WHEN row_number() OVER (PARTITION BY note ORDER BY edition_id) = 1 THEN '' ELSE '#' || row_number() OVER (PARTITION BY note ORDER BY edition_id) END AS url FROM {_E}")
def unique_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """Repeats of an address get a number."""
    n = F.row_number().over(Window.partitionBy("note").orderBy("edition_id"))
    return editions(spark, sf).select("edition_id", F.concat("note", F.when(n == 1, "").otherwise(F.concat(F.lit("#"), n.cast("string")))).alias("url"))
