"""Stamps against an independent reading by strptime and zoneinfo."""

import re
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from palimpsest.operators import instants as I
from palimpsest.session import table

DE = {"Januar": "January", "Februar": "February", "März": "March", "Mai": "May", "Juni": "June", "Juli": "July", "Oktober": "October", "Dezember": "December"}


def by_hand(s, zone, day_first):
    s = re.sub(r"\s+", " ", s).strip()
    us = lambda d: (d - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)
    if re.fullmatch(r"\d+(\.\d+)?", s):
        try:
            if re.fullmatch(r"\d{8}|\d{12}|\d{14}", s):
                return us(datetime.strptime(s.ljust(14, "0"), "%Y%m%d%H%M%S").replace(tzinfo=UTC))
        except ValueError:
            return None
        a, _, b = s.partition(".")
        n = len(a)
        return int(a) * {10: 10**6, 9: 10**6, 13: 1000, 16: 1}[n] + (int(b.ljust(6, "0")[:6]) if b else 0)
    for a, b in DE.items():
        s = re.sub(rf"\b{a}\b", b, s)
    s = s.replace(" Uhr", "").replace(" at ", " ")
    s = re.sub(r"(\.\d{6})\d+", r"\1", s)
    off = None
    if m := re.search(r"(?<=\d)Z$|(?<=\d)z$", s):
        s, off = s[: m.start()], 0
    elif m := re.search(r"(?<=\d\d:\d\d) ?([+-])(\d\d)(?::?(\d\d))?$", s):
        s, off = s[: m.start()], (1 if m[1] == "+" else -1) * (int(m[2]) * 3600 + int(m[3] or 0) * 60)
    elif m := re.search(r"(?<=[\dM]) ([A-Z]{3,4})$", s):
        s = s[: m.start()]
        off = 0 if m[1] in ("GMT", "UTC") else m[1]
    d = None
    df = "%d/%m" if day_first else "%m/%d"
    for f in ("%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dt%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d", "%Y%m%dT%H%M%S", f"{df}/%Y %H:%M", f"{df}/%y %H:%M", f"{df}/%Y %I:%M:%S %p",
              "%a, %d %b %Y %H:%M:%S", "%H:%M:%S %d %b %Y", "%b %d, %Y %I:%M:%S %p", "%d. %B %Y, %H:%M", "%d %B %Y %I:%M%p", "%d %B %Y"):
        try:
            d = datetime.strptime(s, f)
            break
        except ValueError:
            pass
    if d is None:
        return None
    if isinstance(off, int):
        return us(d.replace(tzinfo=UTC)) - off * 10**6
    z = ZoneInfo(zone or "Etc/UTC")
    if off is None:
        return us(d.replace(tzinfo=z, fold=0))
    for fold in (0, 1):
        if d.replace(tzinfo=z, fold=fold).tzname() == off:
            return us(d.replace(tzinfo=z, fold=fold))
    return "?"


def test_all_tables(spark, sf):
    src = {r.provider: (r.zone, r.day_first) for r in table(spark, sf, "stamp_sources").collect()}
    tables = {n: table(spark, sf, n) for n, _, _ in I.FIELDS}
    got = {(r.field, r.row_id): r.utc_us for r in I.all_stamp_cases(tables, table(spark, sf, "stamp_sources")).collect()}
    want, unsure = {}, set()
    for n, f, k in I.FIELDS:
        for r in tables[n].select(k, f, "provider").distinct().collect():
            if r[1] is not None and not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", r[1]):
                zone, first = src.get(r.provider, ("Etc/UTC", True))
                v = by_hand(r[1], zone, first)
                if v == "?":
                    unsure.add((f, r[0]))
                elif v is not None:
                    want[f, r[0]] = v
    assert not unsure
    assert {k: (got.get(k), v) for k, v in want.items() if got.get(k) != v} == {}
    assert set(got) - set(want) == set()


def test_edges(spark):
    rows = [
        (1, "2021-10-31 01:30:00", "uk"), (2, "2021-03-28 01:30:00", "uk"), (3, "2021-03-28 03:10:00+5", "uk"), (4, "31/06/2020 10:00", "uk"), (5, None, "uk"), (6, "", None), (7, "03/04/2020 10:00", "us"), (8, "2020-01-01T24:00:00", "uk"),
        (9, "2021-11-07 01:30:00 EST", "us"), (10, "2021-11-07 01:30:00 EDT", "us"), (11, "0:30 PM", "us"), (12, "1577836800.1234567", None), (13, "20200230", None), (14, "2020-06-01T10:00:00.1234567", "uk"), (15, "2020-12-31T23:59:60Z", "uk"), (16, "x" * 100_000, "uk"),
    ]
    df = spark.createDataFrame(rows, "id long, stamp string, provider string")
    src = spark.createDataFrame([("uk", "Europe/London", True), ("us", "America/New_York", False), ("us", "America/New_York", False)], "provider string, zone string, day_first boolean")
    got = {r.row_id: datetime.fromtimestamp(r.utc_us / 1e6, UTC).isoformat() for r in I.stamp_cases(df, "stamp", "id", src).collect()}
    assert got == {
        1: "2021-10-31T00:30:00+00:00", 2: "2021-03-28T01:30:00+00:00", 7: "2020-03-04T15:00:00+00:00", 9: "2021-11-07T06:30:00+00:00", 10: "2021-11-07T05:30:00+00:00", 12: "2020-01-01T00:00:00.123456+00:00", 14: "2020-06-01T09:00:00.123456+00:00",
    }
    assert I.stamp_cases(df.limit(0), "stamp", "id", src).count() == 0


def test_every_year(spark):
    """Years before and after those with changes of their own: nothing vanishes, and offsets are those of the zone's standing rule."""
    import random

    from pyspark.sql import functions as F

    r = random.Random(1)
    zones = ["Europe/London", "Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "Africa/Casablanca", "America/Sao_Paulo", "Pacific/Apia", "no/where", None]
    fixed = [("1985-07-01 12:00:00", "Europe/London"), ("1985-07-01 12:00:00", None), ("1970-01-01 12:00:00", "Europe/London"), ("2070-07-01 12:00:00", "Europe/London"), ("1988-03-05 00:00:00", "Europe/Berlin")]
    rows = [(i, t, z) for i, (t, z) in enumerate(fixed)]
    for i in range(len(rows), 1500):
        d = datetime(r.choice([1000, 1834, 1900, 1988, 2037, 2087, 2100, 2101, 2128, 2129, 2400, 9998, r.randrange(1840, 2600)]), r.randrange(1, 13), r.randrange(1, 29), r.randrange(24), r.randrange(60))
        rows.append((i, d.strftime("%Y-%m-%d %H:%M:%S"), r.choice(zones)))
    df = spark.createDataFrame(rows, "i int, t string, z string")
    for known in (None, [z for z in zones if z]):
        got = {x.i: x.utc_us for x in I.with_instant(df, "t", F.col("z"), F.lit(True), zones=known).collect()}
        for i, t, z in rows:
            d = datetime.strptime(t, "%Y-%m-%d %H:%M:%S")
            off = d.replace(tzinfo=ZoneInfo("Etc/UTC" if z in (None, "no/where") else z), fold=0).utcoffset()
            assert got[i] == (d - datetime(1970, 1, 1) - timedelta(seconds=int(off.total_seconds()))) // timedelta(microseconds=1), (t, z)
    assert got[3] == 3171438000000000 and got[1] == 489067200000000
