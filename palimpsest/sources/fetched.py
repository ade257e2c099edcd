"""A Python data source of fetched pages, replayed from a mirror.

`spark.read.format("fetched").option("mirror", ...)` walks redirects (at most eight hops), cuts bodies at `max_bytes`, honours refused hosts and
partitions addresses by host, so one task alone asks a host. There is no network here: the mirror is a folder of JSON lines with url, status,
location, body. A live transport implements `answer(url)`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import urljoin, urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HOPS = 8


class Hosts(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class Mirror:
    def __init__(self, folder: str):
        self.pages = {}
        for p in sorted(Path(folder).glob("*.json*")):
            for line in p.read_text().splitlines():
                try:
                    r = json.loads(line)
                    self.pages[r["url"]] = r
                except (ValueError, KeyError):
                    pass

    def answer(self, url: str) -> dict | None:
        return self.pages.get(url)


def fetch(mirror: Mirror, url: str, max_bytes: int, refused: set[str]) -> tuple:
    """(url, final_url, status, outcome, body): outcome is ok, moved, refused, too-large, broken, unreachable, loop."""
    at, seen = url, set()
    for _ in range(HOPS + 1):
        if urlsplit(at).netloc in refused:
            return url, at, None, "refused", None
        if at in seen:
            return url, at, None, "loop", None
        seen.add(at)
        r = mirror.answer(at)
        if r is None:
            return url, at, None, "unreachable", None
        if r["status"] in (301, 302, 303, 307, 308) and r.get("location"):
            at = urljoin(at, r["location"])
            continue
        body = r.get("body") or ""
        if len(body.encode()) > max_bytes:
            return url, at, r["status"], "too-large", None
        fine = 200 <= r["status"] < 300
        return url, at, r["status"], ("ok" if at == url else "moved") if fine else "broken", body if fine else None
    return url, at, None, "loop", None


class Reader(DataSourceReader):
    def __init__(self, options):
        self.mirror = options["mirror"]
        self.urls = [u for u in options.get("urls", "").split() if u]
        self.max_bytes = int(options.get("max_bytes", 20_000_000))
        self.refused = set(options.get("refused", "").split())

    def partitions(self):
        by: dict[str, list[str]] = {}
        for u in self.urls:
            by.setdefault(urlsplit(u).netloc, []).append(u)
        return [Hosts(us) for us in by.values()] or [Hosts([])]

    def read(self, partition: Hosts) -> Iterator[tuple]:
        m = Mirror(self.mirror)
        for u in partition.urls:
            yield fetch(m, u, self.max_bytes, self.refused)


class Fetched(DataSource):
    @classmethod
    def name(cls):
        return "fetched"

    def schema(self):
        return "url string, final_url string, status int, outcome string, body string"

    def reader(self, schema):
        return Reader(self.options)
