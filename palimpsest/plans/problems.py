"""Queries of the general data problems: snapshots, stamps, histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.history import TITLE_HISTORY_SQL, iso_seconds, title_history, title_periods
from palimpsest.operators import instants as I
from palimpsest.operators.instants import FIELDS, all_stamp_cases
from palimpsest.operators.snapshots import NOTE_CHANGES_SQL, note_changes
from palimpsest.session import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return note_changes(table(spark, sf, "note_snapshots"))


def p2_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many notes were added, removed and changed in each snapshot."""
    return note_changes(table(spark, sf, "note_snapshots")).groupBy("snapshot_no", "change").agg(F.count("*").alias("notes"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return all_stamp_cases({n: table(spark, sf, n) for n, _, _ in FIELDS}, table(spark, sf, "stamp_sources"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return title_history(table(spark, sf, "title_log"))


def p4_periods(spark: SparkSession, sf: str) -> DataFrame:
    """The periods with what held in them."""
    p = title_periods(table(spark, sf, "title_log"))
    return p.select("edition_id", iso_seconds(F.col("from_us")).alias("valid_from"), F.coalesce(iso_seconds(F.col("to_us")), F.lit("9999-12-31T23:59:59Z")).alias("valid_to"), "title", iso_seconds(F.col("dated_us")).alias("public_updated_at"))


def _stamps_sql() -> str:
    """The same writings read by the comparison's regular expressions, and its own zones; which offset an abbreviation means is listed by zone."""
    blank = "[\\s\\p{Z}\ufeff\u200b]"
    parts = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN regexp_replace(t, '{p}', '{'|'.join(f'{chr(92)}{g}' if g else '' for g in gs)}|{how}')" for p, gs, how in I.WRITINGS) + " END"
    months = "CASE lower(mo) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in I.MONTHS.items()) + " END"
    zones = ("Etc/UTC", "Europe/London", "Europe/Vienna", "America/New_York", "Asia/Kolkata", "Australia/Sydney")
    named = sorted({(z, abbr.upper(), off) for z in zones for _, hi, off, abbr in I.zone_cuts(z) if hi > 631_152_000_000_000})
    tables = " UNION ALL ".join(f"SELECT '{f}' AS field, {k} AS row_id, {f} AS s, provider FROM (SELECT DISTINCT ON ({k}) {k}, {f}, provider FROM {n})" for n, f, k in FIELDS)
    n = lambda c: f"coalesce(TRY_CAST(nullif({c}, '') AS BIGINT), 0)"
    stamp = "TRY_CAST(printf('%04d-%02d-%02d %02d:%02d:%02d', {0}, {1}, {2}, {3}, {4}, {5}) AS TIMESTAMP)"
    return f"""
WITH named AS (SELECT zone, abbr, CAST(o AS BIGINT) AS off FROM (VALUES {", ".join(f"('{z}', '{a}', {o})" for z, a, o in named)}) v(zone, abbr, o)),
src AS (SELECT provider, min(zone) AS zone, min_by(day_first, zone) AS day_first FROM stamp_sources GROUP BY provider),
raw AS ({tables}),
a AS (SELECT field, row_id, coalesce(zone, 'Etc/UTC') AS home, coalesce(day_first, TRUE) AS df, regexp_replace(regexp_replace(s, '^{blank}+|{blank}+$', '', 'g'), '{blank}+', ' ', 'g') AS t
  FROM raw LEFT JOIN src USING (provider) WHERE s IS NOT NULL AND NOT regexp_full_match(s, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}Z')),
b AS (SELECT *, string_split({parts}, '|') AS p FROM a),
c AS (SELECT field, row_id, home, df, t, p, p[1] AS y, p[2] AS mo, p[3] AS d, {n('p[4]')} AS h, {n('p[5]')} AS mi, {n('p[6]')} AS sec, {n("rpad(substr(p[7], 1, 6), 6, '0')")} AS us, lower(p[8]) AS half, upper(p[9]) AS z, p[10] AS how FROM b),
e AS (SELECT *, CASE WHEN length(y) = 2 THEN 2000 ELSE 0 END + {n('y')} AS yy, CASE WHEN how = '/' AND NOT df THEN {n('d')} WHEN how = 'w' THEN {months} ELSE {n('mo')} END AS mm, CASE WHEN how = '/' AND NOT df THEN {n('mo')} ELSE {n('d')} END AS dd,
  CASE WHEN half = '' THEN h WHEN h BETWEEN 1 AND 12 THEN h % 12 + CASE WHEN half = 'p' THEN 12 ELSE 0 END END AS hh FROM c),
f AS (SELECT *, CASE WHEN p IS NOT NULL AND yy >= 1 AND mm BETWEEN 1 AND 12 AND dd BETWEEN 1 AND 31 AND hh <= 23 AND mi <= 59 AND sec <= 59 THEN {stamp.format('yy', 'mm', 'dd', 'hh', 'mi', 'sec')} END AS wall,
  CASE WHEN z IN ('Z', 'GMT', 'UTC', 'UT') THEN 0 WHEN regexp_matches(z, '^[+-]') THEN CASE WHEN z[1] = '-' THEN -1 ELSE 1 END * ({n("regexp_extract(z, '^.(..)', 1)")} * 3600 + {n("regexp_extract(z, '(..)$', 1)")} * CASE WHEN length(z) > 3 THEN 60 ELSE 0 END) END AS off FROM e),
g AS (SELECT f.*, named.off AS named_off FROM f LEFT JOIN named ON named.zone = f.home AND named.abbr = f.z),
i AS (SELECT *, wall AT TIME ZONE home AS at1 FROM g),
w AS (SELECT field, row_id, CASE
    WHEN p IS NOT NULL THEN CASE WHEN off IS NOT NULL THEN epoch_us(wall) - off * 1000000 WHEN z <> '' THEN epoch_us(wall) - named_off * 1000000 WHEN (at1 - INTERVAL 1 HOUR) AT TIME ZONE home = wall THEN epoch_us(at1) - 3600000000 ELSE epoch_us(at1) END + us
    WHEN regexp_full_match(t, '\\d{{8}}|\\d{{12}}|\\d{{14}}') THEN epoch_us(TRY_CAST(printf('%s-%s-%s %s:%s:%s', substr(t, 1, 4), substr(t, 5, 2), substr(t, 7, 2), substr(rpad(t, 14, '0'), 9, 2), substr(rpad(t, 14, '0'), 11, 2), substr(rpad(t, 14, '0'), 13, 2)) AS TIMESTAMP))
    WHEN regexp_full_match(t, '\\d{{1,17}}(\\.\\d+)?') THEN CASE WHEN TRY_CAST(regexp_extract(t, '^\\d+') AS BIGINT) < 100000000000 THEN TRY_CAST(regexp_extract(t, '^\\d+') AS BIGINT) * 1000000 + {n("rpad(substr(regexp_extract(t, '[.](.*)$', 1), 1, 6), 6, '0')")}
      WHEN TRY_CAST(regexp_extract(t, '^\\d+') AS BIGINT) < 100000000000000 THEN TRY_CAST(regexp_extract(t, '^\\d+') AS BIGINT) * 1000 + {n("substr(rpad(regexp_extract(t, '[.](.*)$', 1), 3, '0'), 1, 3)")} ELSE TRY_CAST(regexp_extract(t, '^\\d+') AS BIGINT) END END AS utc_us FROM i)
SELECT DISTINCT field, row_id, utc_us FROM w WHERE utc_us IS NOT NULL"""


QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts, "p3_found": p3_found, "p4_found": p4_found, "p4_periods": p4_periods}
SQL = {
    "p2_found": NOTE_CHANGES_SQL,
    "p2_counts": f"SELECT snapshot_no, change, count(*) AS notes FROM ({NOTE_CHANGES_SQL}) GROUP BY ALL",
    "p3_found": _stamps_sql(),
    "p4_found": TITLE_HISTORY_SQL,
    "p4_periods": TITLE_HISTORY_SQL.replace("AS valid_to FROM", "AS valid_to, title, strftime(d AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS public_updated_at FROM"),
}
