"""Stamps in many writings, brought to one instant in UTC.

A stamp is read in two steps. `read_stamp` turns any known writing into parts (date, time, fraction, half of the day, zone as written) by
regular expressions in the JVM. `resolve` then joins the local times with exploded zone-offset intervals (zone, year, local start, local
end, offset, abbreviation): two matching intervals mean an ambiguous reading (the earlier instant holds), none means a reading that the
clocks skipped (the offset in force before the change holds), one gives the offset.

Intervals are listed by the year up to LAST_EXPLICIT, the first one open towards the past. Later years follow each zone's standing rule, which
depends only on the weekday of 1 January and on the leap day: each later year is read by the listed one of its kind. So every year has its
intervals, and the number of rows stays zones x 300.

The intervals are the only broadcast side; their bound is checked. No row is shuffled by the join.

Defined cases: null, empty, unreadable and impossible stamps (31 June, month 13, 25 hours, second 60) have no instant; missing parts are
zero; digits past microseconds are cut; two-digit years are 20yy; an abbreviation that the zone never used has no instant.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Zones keep no earlier changes than FIRST_YEAR's, and none of their own after LAST_EXPLICIT; the 28 years that follow it stand for all later ones.
FIRST_YEAR, LAST_EXPLICIT = 1834, 2100
LAST_YEAR = LAST_EXPLICIT + 28
MOST_INTERVALS = 1_000_000
EVER = 1 << 62

MONTHS = {
    "jan": 1, "januar": 1, "january": 1, "feb": 2, "februar": 2, "february": 2, "mar": 3, "march": 3, "märz": 3, "maerz": 3, "mär": 3, "mrz": 3,
    "apr": 4, "april": 4, "may": 5, "mai": 5, "jun": 6, "june": 6, "juni": 6, "jul": 7, "july": 7, "juli": 7, "aug": 8, "august": 8,
    "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "okt": 10, "oktober": 10, "nov": 11, "november": 11,
    "dec": 12, "december": 12, "dez": 12, "dezember": 12, "jän": 1, "jänner": 1,
}

_ZONE = r"(Z|z|[A-Za-z]{2,5}|[+-]\d{2}(?::?\d{2})?)?"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_WEEKDAY = r"(?:\p{L}{2,10}\.?,? )?"
_BLANK = r"[\s\p{Z}\x{feff}\x{200b}]"
#: Writing -> which group holds what: year, month, day, hour, minute, second, fraction, half of the day, zone; 0: nothing.
WRITINGS = [
    (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:[Tt ] ?{_TIME})? ?{_ZONE}$", (1, 2, 3, 4, 5, 6, 7, 0, 8), "n"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)? ?{_ZONE}$", (1, 2, 3, 4, 5, 6, 7, 0, 8), "n"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}})(?:,? {_TIME}(?: ?([AaPp])\.?[Mm]\.?)?)? ?{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 8, 9), "/"),
    (rf"^{_WEEKDAY}(\d{{1,2}})\.? (\p{{L}}+)\.? (\d{{4}}|\d{{2}})(?:(?:,| at| um)? {_TIME}(?: ?([AaPp])\.?[Mm]\.?)?(?: Uhr)?)? ?{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 8, 9), "w"),
    (rf"^{_TIME} {_WEEKDAY}(\d{{1,2}})\.? (\p{{L}}+)\.? (\d{{4}}|\d{{2}}) ?{_ZONE}$", (7, 6, 5, 1, 2, 3, 4, 0, 8), "w"),
    (rf"^{_WEEKDAY}(\p{{L}}+)\.? (\d{{1,2}}), (\d{{4}})(?:,?(?: at)? {_TIME}(?: ?([AaPp])\.?[Mm]\.?)?)? ?{_ZONE}$", (3, 1, 2, 4, 5, 6, 7, 8, 9), "w"),
]
_PARTS = ("y", "mo", "d", "h", "mi", "s", "f", "half", "zone", "how")
EXACT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z\z"


def local_us(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column, us: Column) -> Column:
    """Microseconds from 1970-01-01 00:00 by the same clock; null for what is no date or time."""
    day = F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(mo.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")
    fine = (y >= 1) & mo.between(1, 12) & d.between(1, 31) & h.between(0, 23) & mi.between(0, 59) & s.between(0, 59)
    return F.when(fine, (F.unix_date(day).cast("long") * 86400 + h * 3600 + mi * 60 + s) * 1_000_000 + us)


def kind_of_year(year: Column) -> Column:
    """0 to 13: weekday of 1 January and whether there is a leap day."""
    before = year - 1
    weekday = F.pmod(F.lit(1) + 365 * before + F.floor(before / 4) - F.floor(before / 100) + F.floor(before / 400), F.lit(7))
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return (weekday * 2 + leap.cast("int")).cast("int")


def standing_years() -> dict[int, int]:
    """Kind of year -> the first listed year of that kind after LAST_EXPLICIT."""
    out: dict[int, int] = {}
    for y in range(LAST_EXPLICIT + 1, LAST_YEAR + 1):
        first = datetime(y, 1, 1)
        out.setdefault(first.isoweekday() % 7 * 2 + ((datetime(y + 1, 1, 1) - first).days == 366), y)
    return out


def first_day_us(year: Column) -> Column:
    """Microseconds from 1970 to the year's first day."""
    return F.unix_date(F.make_date(year, F.lit(1), F.lit(1))).cast("long") * 86_400_000_000


def read_stamp(stamp: Column, day_first: Column) -> dict[str, Column]:
    """`local`: microseconds by the writer's clock; `zone`: zone as written, '' if none, 'Z' for UTC. Both null if it is no stamp."""
    t = F.regexp_replace(F.regexp_replace(stamp, rf"^{_BLANK}+|{_BLANK}+$", ""), rf"{_BLANK}+", " ")
    parts = F.lit(None).cast("string")
    for pattern, groups, how in reversed(WRITINGS):
        into = "|".join(f"${g}" if g else "" for g in groups) + f"|{how}"
        parts = F.when(t.rlike(pattern), F.regexp_replace(t, pattern, into)).otherwise(parts)
    p = dict(zip(_PARTS, (F.try_element_at(F.split(F.col("__parts"), r"\|"), F.lit(i + 1)) for i in range(len(_PARTS))), strict=True))
    return {"__t": t, "__parts": parts} | {f"__{k}": v for k, v in p.items()}


def with_instant(df: DataFrame, stamp: str, zone: Column, day_first: Column, out: str = "utc_us", zones: list[str] | None = None) -> DataFrame:
    """`df` with `out`: microseconds since 1970 in UTC that the string column `stamp` denotes, or null.

    `zone`: IANA name that holds where the stamp states none (null: UTC). `day_first`: order of figures with slashes (null: true).
    `zones`: all zones that occur, if they are known; else they are looked up by a pass over the rows.
    Names that begin with two underscores are used inside and must be free.
    """
    steps = read_stamp(F.col(stamp), day_first)
    df = df.withColumn("__home", F.coalesce(zone, F.lit("Etc/UTC"))).withColumn("__df", F.coalesce(day_first, F.lit(True)))
    for k in ("__t", "__parts"):
        df = df.withColumn(k, steps[k])
    df = df.withColumns({k: v for k, v in steps.items() if k not in ("__t", "__parts")})
    text = lambda k: F.col(f"__{k}")
    number = lambda k: F.when(text(k) == "", F.lit(0)).otherwise(text(k).try_cast("int"))
    month_names = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    month = F.when(text("how") == "w", F.try_element_at(month_names, F.lower(text("mo")))).otherwise(text("mo").try_cast("int"))
    day = text("d").try_cast("int")
    swap = (text("how") == "/") & ~F.col("__df")
    year = F.when(F.length(text("y")) == 2, F.lit(2000) + text("y").try_cast("int")).otherwise(text("y").try_cast("int"))
    half, hour = F.lower(text("half")), number("h")
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    us = F.when(text("f") == "", F.lit(0)).otherwise(F.rpad(F.substring(text("f"), 1, 6), 6, "0").try_cast("int"))
    local = local_us(year, F.when(swap, day).otherwise(month), F.when(swap, month).otherwise(day), hour, number("mi"), number("s"), us)

    # bare numbers
    t = F.col("__t")
    whole = t.rlike(r"^\d+$")
    stampish = whole & F.length(t).isin(8, 12, 14)
    at = lambda i, n: F.coalesce(F.nullif(F.substring(t, i, n), F.lit("")), F.lit("0")).try_cast("int")
    calendar = local_us(at(1, 4), at(5, 2), at(7, 2), at(9, 2), at(11, 2), at(13, 2), F.lit(0))
    units = F.regexp_extract(t, r"^(\d{1,18})", 1).try_cast("long")
    fraction = F.rpad(F.substring(F.regexp_extract(t, r"^\d+\.(\d+)$", 1), 1, 6), 6, "0")
    size = F.when(units < 100_000_000_000, 1_000_000).when(units < 100_000_000_000_000, 1_000).when(units < 100_000_000_000_000_000, 1)
    since = units * size + F.when(t.rlike(r"^\d+\.\d+$"), (F.when(fraction == "", F.lit("0")).otherwise(fraction)).try_cast("long") * size / 1_000_000).otherwise(0).cast("long")
    number_us = F.when(stampish, calendar).when(t.rlike(r"^\d{1,17}(?:\.\d+)?$"), since)

    # stated zones
    z = F.upper(text("zone"))
    digits = F.regexp_replace(z, "[^0-9]", "")
    off_h, off_m = F.substring(digits, 1, 2).try_cast("int"), F.coalesce(F.nullif(F.substring(digits, 3, 2), F.lit("")), F.lit("0")).try_cast("int")
    offset = F.when(z.isin("Z", "GMT", "UTC", "UT"), F.lit(0)).when(z.rlike(r"^[+-]") & off_h.between(0, 18) & off_m.between(0, 59), F.when(z.startswith("-"), -1).otherwise(1) * (off_h * 3600 + off_m * 60))
    df = df.withColumns({"__local": local, "__number": number_us, "__z": z, "__offset": offset.cast("long")})
    # a later year is read by the listed one of its kind; `__moved`: how far the local time moves for that
    own = F.col("__own")
    standing = F.try_element_at(F.create_map(*[F.lit(x) for kv in standing_years().items() for x in kv]), kind_of_year(own))
    df = df.withColumn("__own", F.when(F.col("__local").isNotNull() & F.col("__parts").isNotNull() & F.col("__offset").isNull(), year))
    df = df.withColumn("__year", F.when(own > LAST_EXPLICIT, standing).otherwise(F.greatest(own, F.lit(FIRST_YEAR))))
    df = df.withColumn("__moved", F.when(own > LAST_EXPLICIT, first_day_us(own) - first_day_us(F.col("__year"))).otherwise(F.lit(0)))
    df = df.withColumn("__at", F.col("__local") - F.col("__moved"))

    cuts = intervals(df, zones)
    df = df.join(F.broadcast(cuts), (df["__home"] == cuts["__zone"]) & (df["__year"] == cuts["__in"]), "left").drop("__in").drop(cuts["__zone"])
    named = F.col("__z") != ""
    x = lambda k: f"x.{k}"
    df = df.withColumn("__hits", F.expr(f"filter(__cuts, x -> __at >= {x('lo')} and __at < {x('hi')} and (__z = '' or upper({x('abbr')}) = __z))"))
    df = df.withColumn("__before", F.expr("filter(__cuts, x -> __at >= x.lo)"))
    df = df.withColumn("__like", F.expr("filter(__cuts, x -> upper(x.abbr) = __z)"))
    latest = F.expr("array_max(transform(__before, x -> struct(x.lo, x.off)))")["off"]
    earliest_instant = F.expr("array_max(transform(__hits, x -> x.off))")
    stated = F.coalesce(earliest_instant, F.expr("array_max(transform(__like, x -> struct(x.lo, x.off)))")["off"])
    own = F.when(F.size("__hits") > 0, earliest_instant).otherwise(latest)
    off = F.coalesce(F.col("__offset"), F.when(named, stated).otherwise(own))
    df = df.withColumn(out, F.when(F.col("__parts").isNotNull(), F.col("__local") - off * 1_000_000).otherwise(F.col("__number")))
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def zone_cuts(zone: str, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> list[tuple[int, int, int, str]]:
    """Offset intervals of one zone: local start and end in microseconds, offset in seconds, abbreviation; found by bisection between months."""
    tz = ZoneInfo(zone)
    state = lambda t: (lambda d: (int(d.utcoffset().total_seconds()), d.tzname()))(datetime.fromtimestamp(t, UTC).astimezone(tz))
    t, end = int(datetime(first - 1, 1, 1, tzinfo=UTC).timestamp()), int(datetime(last + 2, 1, 1, tzinfo=UTC).timestamp())
    out, start, now, step = [], t, state(t), int(timedelta(days=7).total_seconds())
    while t < end:
        nxt = min(t + step, end)
        if state(nxt) != now:
            a, b = t, nxt
            while b - a > 1:
                m = (a + b) // 2
                a, b = (m, b) if state(m) == now else (a, m)
            out.append((start, b, *now))
            start, t, now = b, b, state(b)
        else:
            t = nxt
    out.append((start, end, *now))
    cuts = [((a + off) * 1_000_000, (b + off) * 1_000_000, off, abbr) for a, b, off, abbr in out]
    return [(-EVER, *cuts[0][1:]), *cuts[1:]]


def intervals(df: DataFrame, zones: list[str] | None = None) -> DataFrame:
    """Exploded by year and gathered again by (zone, year): every local time finds the few intervals near it by an equi-join.

    Zones are those given, or those in `__home`; there are some hundreds of zones in the world, and the driver checks that.
    """
    spark = df.sparkSession
    found = sorted({*zones, "Etc/UTC"}) if zones is not None else [r[0] for r in df.select("__home").distinct().limit(1001).collect()]
    if len(found) > 1000:
        raise ValueError("more than 1000 zones: the zone column holds something else")
    rows = []
    for zone in found:
        try:
            cuts = zone_cuts(zone)
        except (KeyError, ValueError, OSError):
            cuts = zone_cuts("Etc/UTC")  # a zone that doesn't exist counts as not listed
        k = 0
        for year in range(FIRST_YEAR, LAST_YEAR + 1):
            # a gap's reading needs the interval before it, an abbreviation any of the year's
            lo, hi = (int(datetime(y, 1, 1, tzinfo=UTC).timestamp()) * 1_000_000 for y in (year, year + 1))
            while cuts[k][1] <= lo - 86_400_000_000:
                k += 1
            near = [c for c in cuts[k : k + 40] if c[0] < hi + 86_400_000_000]
            rows.append((zone, year, near))
    if sum(len(r[2]) for r in rows) > MOST_INTERVALS:
        raise ValueError("too many zone intervals to broadcast")
    return spark.createDataFrame(rows, "__zone string, __in int, __cuts array<struct<lo: bigint, hi: bigint, off: bigint, abbr: string>>")


def listed_zones(sources: DataFrame) -> list[str]:
    """Zones of the table of sources, which is small and fixed; the driver checks its size."""
    found = [r[0] for r in sources.where("zone IS NOT NULL").select("zone").distinct().limit(1001).collect()]
    if len(found) > 1000:
        raise ValueError("more than 1000 zones in the table of sources")
    return found


def stamps(df: DataFrame, field: str, key: str) -> DataFrame:
    """`field`, `row_id`, `stamp`, `provider` of the values that are stated and not yet written yyyy-MM-ddTHH:mm:ssZ."""
    rows = df.select(F.lit(field).alias("field"), F.col(key).cast("long").alias("row_id"), F.col(field).alias("stamp"), "provider")
    return rows.where(F.col("stamp").isNotNull() & ~F.col("stamp").rlike(EXACT))


def resolved_stamps(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """`field`, `row_id`, `utc_us` of every stamp that denotes an instant.

    `sources`: provider, zone, day_first; one row a provider (of several the first by zone), broadcast only as far as Spark finds it small.
    """
    src = sources.groupBy("provider").agg(F.min(F.struct("zone", "day_first")).alias("s")).select(F.col("provider").alias("__p"), F.col("s.zone").alias("__zn"), F.col("s.day_first").alias("__first"))
    rows = rows.join(src, rows["provider"] == src["__p"], "left").withColumnsRenamed({"__zn": "zn", "__first": "first"})
    found = with_instant(rows, "stamp", F.col("zn"), F.col("first"), zones=listed_zones(sources))
    return found.where("utc_us is not null").select("field", "row_id", "utc_us").dropDuplicates(["field", "row_id"])


def stamp_cases(df: DataFrame, field: str, key: str, sources: DataFrame) -> DataFrame:
    """As `resolved_stamps`, of one column of one table."""
    return resolved_stamps(stamps(df, field, key), sources)


FIELDS = (("export_editions", "public_updated_at", "edition_id"), ("captures", "captured_at", "capture_id"), ("repository_downloads", "downloaded_at", "download_id"))


def all_stamp_cases(tables: dict[str, DataFrame], sources: DataFrame) -> DataFrame:
    """All fields in one plan: the writings are compiled and the zones looked up once."""
    out = None
    for name, field, key in FIELDS:
        found = stamps(tables[name], field, key)
        out = found if out is None else out.unionByName(found)
    return resolved_stamps(out, sources)
