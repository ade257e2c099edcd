"""Readers and writers: JSON documents, tolerant logs, bodies, listings, lists, exports.

Readers take explicit schemas, so a missing file or field is a null or an empty table, not a guess.
"""

from __future__ import annotations

import zlib
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# readers


def read_documents(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON documents, one a file; an absent path is an empty table."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    if found is None or not len(found):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _parsed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__damaged"}
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select("value", F.from_json("value", f"{schema}, __damaged string", how).alias("r"))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; damaged lines are skipped, the rest is kept."""
    return _parsed(spark, path, schema).where("r.__damaged IS NULL").select("r.*").drop("__damaged")


def damaged_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return _parsed(spark, path, schema).where("r.__damaged IS NOT NULL").select(F.col("value").alias("line"))


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Bodies by the beginning of their hash, which is their file's name; `sha16`, `body`, `ok` (the content has that hash)."""
    f = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([0-9a-f]{16})[0-9a-f]*\.\w+$", 1)
    return f.select(name.alias("sha16"), F.decode("content", "UTF-8").alias("body"), F.sha2("content", 256).startswith(name).alias("ok")).where("sha16 <> ''")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Addresses, one a line, each once; blank lines and comments are skipped, anything else rejects the list."""
    t = spark.read.text(path).select(F.trim("value").alias("url")).where("url <> '' AND NOT startswith(url, '#')")
    checked = F.when(F.col("url").rlike(r"(?i)^https?://[^/\s]+\S*$"), F.col("url")).otherwise(F.raise_error(F.concat(F.lit("not an address: "), F.col("url"))))
    return t.select(checked.alias("url")).distinct()


def listed(df: DataFrame, items: str = "links.documents") -> DataFrame:
    """Rows of a nested list."""
    return df.select(F.explode(items).alias("item")).select("item.*")


def attachments(df: DataFrame, kind: str, items: str = "details.attachments") -> DataFrame:
    """Rows of nested attachments of one kind."""
    return df.select(F.explode(F.filter(F.col(items), lambda a: a["attachment_type"] == kind)).alias("item")).select("item.*")


def split_payload(df: DataFrame, struct: str, payload: str) -> DataFrame:
    """A struct's payload as a column of its own, and the struct without it."""
    return df.withColumn(payload, F.col(f"{struct}.{payload}")).withColumn(struct, F.col(struct).dropFields(payload))


def page_lines(df: DataFrame, key: str, pages: str) -> DataFrame:
    """Plain page texts as lines: key, page, line, text."""
    p = df.select(key, F.posexplode(pages).alias("page", "text"))
    return p.select(key, (F.col("page") + 1).alias("page"), F.posexplode(F.split("text", "\n")).alias("line", "text"))


def content_kind(content: Column, mime: Column) -> Column:
    """What bytes are by their first ones, then by their declared type: pdf, gzip, html, json, text, binary."""
    head = F.lower(F.decode(F.substring(content, 1, 512), "ISO-8859-1"))
    return (
        F.when(head.startswith("%pdf-"), "pdf").when(F.hex(F.substring(content, 1, 2)) == "1F8B", "gzip").when(head.rlike(r"^\s*(?:<!doctype html|<html|<head|<body)"), "html")
        .when(head.rlike(r"^\s*[\[{]") & F.coalesce(mime.contains("json"), F.lit(False)), "json").when(F.coalesce(mime.startswith("text/html"), F.lit(False)), "html").when(F.coalesce(mime.startswith("text/"), F.lit(False)), "text").otherwise("binary")
    )


def _gunzip(content: pd.Series) -> pd.Series:
    def one(b):
        try:
            return zlib.decompress(b, 47).decode("utf-8", "replace")
        except (zlib.error, TypeError):
            return None

    return content.map(one)


def gunzipped(content: Column) -> Column:
    """Text of gzipped bytes; null if they are damaged."""
    return F.pandas_udf(_gunzip, "string")(content)


class _Links(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.open = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "a" and (h := dict(attrs).get("href")):
            self.open = [h, ""]

    def handle_data(self, data):
        if self.open:
            self.open[1] += data

    def handle_endtag(self, tag):
        if tag == "a" and self.open:
            self.rows.append((self.open[0], " ".join(self.open[1].split())))
            self.open = None


def listing_links(df: DataFrame, key: str, html: str) -> DataFrame:
    """Links of listing pages: key, href, text; the first of each address counts."""

    def run(it):
        for p in it:
            rows = []
            for k, h in zip(p["k"], p["h"], strict=True):
                parser = _Links()
                parser.feed(h or "")
                rows += [(k, i, *r) for i, r in enumerate(parser.rows)]
            yield pd.DataFrame(rows, columns=["k", "i", "href", "text"])

    kind = df.schema[key].dataType.simpleString()
    found = df.select(F.col(key).alias("k"), F.col(html).alias("h")).mapInPandas(run, f"k {kind}, i int, href string, text string")
    return found.groupBy("k", "href").agg(F.min_by("text", "i").alias("text")).withColumnRenamed("k", key)


class _Divs(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.found = [], []

    def handle_starttag(self, tag, attrs):
        if tag == "div":
            self.stack.append([dict(attrs).get("class") or "", self.getpos(), 0, len(self.stack)])

    def handle_data(self, data):
        for d in self.stack:
            d[2] += len("".join(data.split()))

    def handle_endtag(self, tag):
        if tag == "div" and self.stack:
            self.found.append((*self.stack.pop(), self.getpos()))


def densest_div(html: str | None, wanted: str) -> str | None:
    """The inner part of the div of a class that holds most text; the deepest among equal ones."""
    p = _Divs()
    p.feed(html or "")
    hits = [d for d in p.found if wanted in d[0].split()]
    if not hits:
        return None
    lines = html.split("\n")
    start = [0]
    for x in lines:
        start.append(start[-1] + len(x) + 1)
    _, (l0, c0), _, _, (l1, c1) = max(hits, key=lambda d: (d[2], d[3]))
    a = start[l0 - 1] + c0
    return html[html.index(">", a) + 1 : start[l1 - 1] + c1]


# writers


def safe_cell(c: Column) -> Column:
    """A cell that a spreadsheet doesn't take for a formula."""
    return F.regexp_replace(c, "^([=+\\-@\t\r])", "'$1")


def write_csv(df: DataFrame, path: str) -> None:
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    df.withColumns({c: safe_cell(F.col(c)) for c in text}).write.mode("overwrite").option("header", True).csv(path)


def append_log(df: DataFrame, path: str) -> None:
    """Adds lines; the commit protocol leaves no torn ones."""
    df.write.mode("append").json(path)


def write_series(df: DataFrame, path: str, by: str = "country") -> None:
    """One folder for each value, stale files of written values replaced only."""
    df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).json(path)


def write_records(df: DataFrame, path: str) -> dict[str, int]:
    """Writes JSON lines and returns counts that were observed on the way: no second pass."""
    o = Observation()
    df.observe(o, F.count("*").alias("records"), F.count_if(F.coalesce(F.col("content") == "", F.lit(True))).alias("empty")).write.mode("overwrite").json(path)
    return o.get


def write_markdown(df: DataFrame, group: str, line: Column, path: str) -> None:
    """A heading for each group, a line for each row."""
    g = df.groupBy(group).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    g.select(F.concat(F.lit("## "), F.col(group), F.lit("\n\n- "), F.array_join("lines", "\n- "), F.lit("\n")).alias("value")).orderBy("value").write.mode("overwrite").text(path)
