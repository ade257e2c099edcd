"""Hosts and nearest captures over stamps in any writing, against plain loops over the instants of `test_instants.by_hand`."""

from datetime import UTC, datetime, timedelta

from palimpsest.plans import editions as P
from palimpsest.session import table
from tests.test_instants import by_hand

DAY = 86_400_000_000
SOURCES = [("uk", "Europe/London", True), ("us", "America/New_York", False)]
#: capture, edition, provider, stamp; two of edition 1 delivered twice
CAPTURES = [
    (1, 1, "uk", "2021-06-01T10:00:00Z"), (2, 1, "uk", "03/06/2021 12:00"), (3, 1, "us", "06/05/2021 09:00:00 AM"), (4, 2, "uk", "20210720T080000"),
    (5, 2, "us", "21 July 2021"), (6, 2, None, "1626998400"), (7, 1, "uk", "31 June 2021"), (8, 1, "uk", None), (9, 3, "us", "2020-01-01 05:00:00"), (2, 1, "uk", "03/06/2021 12:00"),
]
EDITIONS = [(1, "a", datetime(2021, 6, 2)), (2, "a", datetime(2021, 7, 19)), (3, "b", datetime(2021, 1, 1))]
DOWNLOADS = [(1, "a", "uk", "04/06/2021 12:00"), (2, "a", "us", "2021-07-20T06:00:00Z"), (3, "b", "us", "Jan 5, 2021 01:00:00 PM"), (4, "a", "uk", "soon"), (1, "a", "uk", "04/06/2021 12:00")]


def us(d):
    return (d.replace(tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


def instants(rows):
    by = {p: (z, d) for p, z, d in SOURCES}
    out = {}
    for r in rows:
        t = by_hand(r[3], *by.get(r[2], ("Etc/UTC", True))) if r[3] and r[3] not in ("soon", "31 June 2021") else None
        if t is not None:
            out[r[0]] = (r[1], t)
    return out


def fixture(spark, at):
    for name, rows, schema in (
        ("stamp_sources", SOURCES, "provider string, zone string, day_first boolean"), ("captures", CAPTURES, "capture_id long, edition_id long, provider string, captured_at string"),
        ("export_editions", EDITIONS, "edition_id long, note string, first_seen timestamp"), ("repository_downloads", DOWNLOADS, "download_id long, note string, provider string, downloaded_at string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def brute_hosts(captures, editions):
    note = {e: n for e, n, _ in editions}
    out = {}
    for c, (e, t) in captures.items():
        host = max(((us(s), x) for x, n, s in editions if n == note[e] and us(s) <= t + 3 * DAY), default=None)
        out[c] = (host and host[1], bool(host) and t - host[0] <= 45 * DAY)
    return out


def brute_nearest(downloads, captures, editions):
    note = {e: n for e, n, _ in editions}
    near = {d: min(((abs(t - ct), c) for c, (e, ct) in captures.items() if note[e] == n), default=None) for d, (n, t) in downloads.items()}
    return {d: x[1] for d, x in near.items() if x}


def test_dated(spark, tmp_path):
    at = fixture(spark, tmp_path)
    captures, downloads = instants(CAPTURES), instants(DOWNLOADS)
    assert set(captures) == {1, 2, 3, 4, 5, 6, 9} and set(downloads) == {1, 2, 3}
    hosts = [tuple(r) for r in P.dated_timeline_hosts(spark, at).collect()]
    assert len(hosts) == len(captures) and {c: (h, a) for c, h, a in hosts} == brute_hosts(captures, EDITIONS)
    near = [tuple(r) for r in P.dated_nearest_capture(spark, at).collect()]
    assert len(near) == 3 and dict(near) == brute_nearest(downloads, captures, EDITIONS)


def test_every_dated_row(spark, sf):
    """On the given tables: exact stamps by their text, the others by stamp_cases, brute force over both."""
    from palimpsest.operators.instants import EXACT, stamp_cases

    src, editions = table(spark, sf, "stamp_sources"), [(r.edition_id, r.note, r.first_seen) for r in table(spark, sf, "export_editions").dropDuplicates(["edition_id"]).collect()]

    def every(name, field, key, keep):
        t = table(spark, sf, name).dropDuplicates([key])
        other = {r.row_id: r.utc_us for r in stamp_cases(t, field, key, src).collect()}
        exact = {r[0]: r[1] for r in t.where(t[field].rlike(EXACT)).selectExpr(key, f"unix_micros(try_cast({field} AS timestamp))").collect() if r[1] is not None}
        rest = {r[0]: r[1] for r in t.select(key, keep).collect()}
        return {k: (rest[k], t) for k, t in (exact | other).items()}

    captures = every("captures", "captured_at", "capture_id", "edition_id")
    known = {e for e, _, _ in editions}
    captures = {k: v for k, v in captures.items() if v[0] in known}
    downloads = every("repository_downloads", "downloaded_at", "download_id", "note")
    assert {r[0]: (r[1], r[2]) for r in P.dated_timeline_hosts(spark, sf).collect()} == brute_hosts(captures, editions)
    assert {r[0]: r[1] for r in P.dated_nearest_capture(spark, sf).collect()} == brute_nearest(downloads, captures, editions)
