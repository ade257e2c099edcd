import gzip
import hashlib
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from palimpsest.sources import files as S
from palimpsest.sources.fetched import Fetched


def test_documents_and_lists(spark, tmp_path):
    doc = {"links": {"documents": [{"title": "A", "base_path": "/a"}, {"title": "B", "base_path": "/b"}]}, "details": {"body": "<p>x</p>", "attachments": [{"attachment_type": "html", "url": "/h"}, {"attachment_type": "file", "url": "/f.pdf"}]}}
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=1))
    schema = "links struct<documents: array<struct<title: string, base_path: string>>>, details struct<body: string, attachments: array<struct<attachment_type: string, url: string>>>"
    df = S.read_documents(spark, str(tmp_path / "d.json"), schema)
    assert [r.title for r in S.listed(df).collect()] == ["A", "B"]
    assert [r.url for r in S.attachments(df, "html").collect()] == ["/h"]
    row = S.split_payload(df, "details", "body").first()
    assert row.body == "<p>x</p>" and "body" not in row.details.asDict()
    assert S.read_documents(spark, str(tmp_path / "none.json"), schema).count() == 0


def test_log(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"url": "a", "seq": 1}\n{"url": "b", "se\n{"url": "a", "seq": 2}\n')
    df = S.read_log(spark, str(p), "url string, seq int")
    assert sorted((r.url, r.seq) for r in df.collect()) == [("a", 1), ("a", 2)]
    assert S.damaged_lines(spark, str(p), "url string, seq int").count() == 1
    S.append_log(df, str(tmp_path / "out"))
    S.append_log(df, str(tmp_path / "out"))
    assert S.read_log(spark, str(tmp_path / "out"), "url string, seq int").count() == 4


def test_bodies_and_addresses(spark, tmp_path):
    body = "<p>é</p>"
    sha = hashlib.sha256(body.encode()).hexdigest()
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / f"{sha[:16]}.html").write_text(body)
    (tmp_path / "b" / f"{'0' * 16}.html").write_text(body)
    assert {(r.sha16, r.body, r.ok) for r in S.read_bodies(spark, str(tmp_path / "b")).collect()} == {(sha[:16], body, True), ("0" * 16, body, False)}
    (tmp_path / "l.txt").write_text("# list\nhttps://a.example/1\n\nhttps://a.example/1\nhttp://b.example\n")
    assert S.read_list(spark, str(tmp_path / "l.txt")).count() == 2
    (tmp_path / "bad.txt").write_text("https://a.example/1\nnonsense\n")
    with pytest.raises(PySparkException):
        S.read_list(spark, str(tmp_path / "bad.txt")).collect()


def test_content(spark):
    rows = [(b"%PDF-1.7 x", "text/html"), (gzip.compress(b"hi"), None), (b"  <!DOCTYPE html><p>", None), (b'{"a": 1}', "application/json"), (b"plain", "text/plain"), (b"\x00\x01", None)]
    df = spark.createDataFrame([(bytearray(a), b) for a, b in rows], "c binary, m string")
    assert [r.k for r in df.select(S.content_kind(F.col("c"), F.col("m")).alias("k")).collect()] == ["pdf", "gzip", "html", "json", "text", "binary"]
    assert [r.t for r in df.select(S.gunzipped(F.col("c")).alias("t")).collect()] == [None, "hi", None, None, None, None]


def test_pages(spark):
    html = '<div class="nav"><a href="/x">One</a></div>\n<div class="main"><div class="body main">Text <a href="/x">Two</a><a href="/y"> Three  words</a></div></div>'
    df = spark.createDataFrame([(1, html)], "id long, html string")
    assert {(r.href, r.text) for r in S.listing_links(df, "id", "html").collect()} == {("/x", "One"), ("/y", "Three words")}
    assert S.densest_div(html, "main").startswith("Text") and S.densest_div(html, "none") is None
    lines = S.page_lines(spark.createDataFrame([(1, ["a\nb", "c"])], "id long, pages array<string>"), "id", "pages")
    assert sorted((r.page, r.line, r.text) for r in lines.collect()) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("A", "=1+1", 3), ("B", "plain", -1), ("A", "-x", 2)], "country string, content string, n int")
    S.write_csv(df, str(tmp_path / "csv"))
    assert {r.content for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()} == {"'=1+1", "plain", "'-x"}
    S.write_series(df, str(tmp_path / "series"))
    S.write_series(df.where("country = 'A'").limit(1), str(tmp_path / "series"))
    assert {r.country: r["count"] for r in spark.read.json(str(tmp_path / "series")).groupBy("country").count().collect()} == {"A": 1, "B": 1}
    assert S.write_records(df, str(tmp_path / "records")) == {"records": 3, "empty": 0}
    S.write_markdown(df, "country", F.col("content"), str(tmp_path / "md"))
    assert "## A" in "".join(p.read_text() for p in (tmp_path / "md").glob("part*"))


def test_fetched(spark, tmp_path):
    pages = [{"url": "https://a.example/", "status": 200, "body": "home"}, {"url": "https://a.example/old", "status": 301, "location": "/"}, {"url": "https://b.example/loop", "status": 302, "location": "/loop"}, {"url": "https://b.example/big", "status": 200, "body": "x" * 100}, {"url": "https://b.example/gone", "status": 404}]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, pages)) + "\n{torn")
    spark.dataSource.register(Fetched)
    urls = " ".join([*(p["url"] for p in pages), "https://c.example/x", "https://d.example/y"])
    got = {r.url: (r.outcome, r.body) for r in spark.read.format("fetched").option("mirror", str(tmp_path)).option("urls", urls).option("max_bytes", 50).option("refused", "d.example").load().collect()}
    assert got == {
        "https://a.example/": ("ok", "home"), "https://a.example/old": ("moved", "home"), "https://b.example/loop": ("loop", None), "https://b.example/big": ("too-large", None),
        "https://b.example/gone": ("broken", None), "https://c.example/x": ("unreachable", None), "https://d.example/y": ("refused", None),
    }
