"""Evidence checks over citations and claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import quotes as Q
from palimpsest.operators import rules as R
from palimpsest.operators.neighbours import beside_previous
from palimpsest.plans.registry import query
from palimpsest.session import once, spread, table


FIELDS = {f.split()[0]: f.split(None, 1)[1] for f in R.SCHEMA.replace("\n", " ").split(", ") if not f.strip().startswith(("similarity", "excerpt", "differences", "changed", "form_only", "figures_only", "attribution", "share", "marker", "agreed"))} | {"near": Q.NEAR}
#: Occurrences of editions are numbered after those of documents.
OF_EDITIONS = 1 << 50


def complete(df: DataFrame) -> DataFrame:
    """All columns of an occurrence; what isn't known is null."""
    return df.select(*[F.col(k).cast(v) if k in df.columns else F.lit(None).cast(v).alias(k) for k, v in FIELDS.items()])


def footnotes(spark: SparkSession, sf: str) -> DataFrame:
    """Every footnote of the documents as an occurrence: its text is the citation, its address the source; no source text is held."""
    d = table(spark, sf, "documents").where("kind = 'footnotes'").select("doc_id", F.date_format("published_on", "yyyy-MM-dd").alias("published"), F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")))
    d = d.select("doc_id", (F.col("doc_id") * 10_000 + F.col("pos")).alias("occurrence"), "published", F.regexp_extract("col", r"^\s*\d+\.\s+(.*)$", 1).alias("cite")).where("cite <> ''")
    href = F.nullif(F.regexp_extract("cite", r"(https?://[^\s,;)]+)", 1), F.lit(""))
    d = d.withColumns({"href": href, "url": href})
    # dates under which one document cites one address
    dated = d.where("url IS NOT NULL").select("doc_id", "url", F.explode(T.dates(F.split("cite", r"(?i)\baccessed\b")[0])).alias("day")).distinct().groupBy(F.col("doc_id").alias("d"), F.col("url").alias("u")).agg(F.array_sort(F.collect_set("day")).alias("url_dates"))
    return complete(d.join(dated, (F.col("doc_id") == F.col("d")) & (F.col("url") == F.col("u")), "left"))


def editions_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Every paragraph of an edition as an occurrence with its evidence.

    References and targets are those of its footnotes; the citation is the first footnote it refers to; the source is the edition of the note
    before it, read in two ways, by sections as pages, with the hash the table states; the receipt is the note's first download.
    """
    e = once(spread(table(spark, sf, "export_editions").select("edition_id", "note", "title", "first_seen", "sha256", "body")), "edition_id")
    p = beside_previous(e, "note", ["first_seen", "edition_id"], "edition_id", ["note", "title", "first_seen", "sha256", "body"])
    old = F.col("previous_body")
    seen = T.visible_text(F.regexp_replace(old, r"(?i)</?(?:p|li|h[1-6]|td|th|tr|div|section|ol|ul)\b[^>]*>", " "))
    ids = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r'\sid="([^"]+)"'), F.lit(1))
    p = p.select(
        "edition_id", "note", F.date_format("first_seen", "yyyy-MM-dd").alias("published"), ids(F.col("body")).alias("all_ids"),
        F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r'(?is)<li id="fn:[^"]+"[^>]*>.*?</li\s*>'), F.lit(0)).alias("notes"), F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"(?is)<(?:p|li)\b[^>]*>.*?</(?:p|li)\s*>"), F.lit(0)).alias("blocks"),
        F.when(old.isNotNull(), T.normal_quotation(seen)).alias("doc"), F.when(old.isNotNull(), T.normal_quotation(F.regexp_replace(T.without_markup(F.regexp_replace(old, r"&[a-z#0-9]+;", " "), " "), r"\s+", " "))).alias("second"),
        old.alias("content"), F.col("previous_sha256").alias("receipt_sha"), F.col("previous_title").alias("headers"), F.array_distinct(T.dates(seen)).alias("doc_dates"), F.when(old.isNotNull(), ids(old)).alias("anchors"),
        F.when(old.isNotNull(), F.transform(F.split(old, r"(?i)<h2\b"), lambda x: T.normal_quotation(T.without_markup(x, " ")))).alias("page_texts"),
    )
    p = p.withColumns({
        "labels": F.transform(F.sequence(F.lit(1), F.size("page_texts")), lambda i: i.cast("string")),
        "bib_dates": F.flatten(F.transform(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r'(?is)<li id="fn:[^"]+"[^>]*>(.*?)</li\s*>'), F.lit(1)), T.dates)),
    })
    d = table(spark, sf, "repository_downloads")
    first = d.groupBy(F.col("note").alias("n")).agg(F.min_by(F.struct("original_url", "url", "status", "pages", "downloaded_at"), "download_id").alias("r"))
    # before the paragraphs are taken apart: texts move once
    p = p.join(first, F.col("note") == F.col("n"), "left")
    # of the whole source: once an edition, not once a paragraph
    p = p.withColumns({"same_reading": T.normal_key(F.col("doc")) == T.normal_key(F.col("second")), "intact": F.sha2("content", 256) == F.col("receipt_sha")})
    # entities are decoded by edition: rows with whole texts go through Python once, not once a paragraph
    p = p.withColumns({"block_texts": T.decoded_all(F.transform("blocks", lambda x: T.without_markup(x))), "note_texts": T.decoded_all(F.transform("notes", lambda x: T.without_markup(F.replace(x, F.lit("↩"), F.lit("")))))})
    p = p.withColumn("parts", F.arrays_zip(F.col("blocks").alias("block"), F.col("block_texts").alias("said"))).drop("blocks", "block_texts")
    b = p.select("*", F.posexplode("parts").alias("pos", "part")).drop("parts").select("*", "part.block", "part.said").drop("part")
    refs = F.regexp_extract_all("block", F.lit(r'href="#(fn:[^"]+)"'), F.lit(1))
    b = b.withColumns({"refs": refs, "targets": F.filter("all_ids", lambda x: x.startswith("fn:"))}).where(~F.col("block").rlike(r'^<li id="fn:'))
    mine = F.get(F.filter("note_texts", lambda x, i: F.get("notes", i).startswith(F.concat(F.lit('<li id="'), F.get(F.col("refs"), 0), F.lit('"')))), 0)
    b = b.withColumns({"claim": T.claim_text(T.collapsed(F.col("said"))), "cite": F.coalesce(T.collapsed(mine), F.lit("")), "occurrence": F.lit(OF_EDITIONS) + F.col("edition_id") * 10_000 + F.col("pos")})
    b = b.withColumn("cite", F.nullif("cite", F.lit("")))
    status = F.when(F.col("r.status") == "saved", "downloaded").otherwise(F.col("r.status"))
    return complete(b.withColumns({
        "url": F.col("r.original_url"), "href": F.col("r.original_url"), "final_url": F.col("r.url"), "status": status, "pages": F.coalesce("r.pages", F.size("page_texts")), "fetched_at": F.col("r.downloaded_at"),
        "kind": F.when(F.lower("r.original_url").rlike(r"\.pdf$"), "pdf").otherwise("html"), "bib_urls": F.when(F.col("r").isNotNull(), F.array("r.original_url")),
    }))


def occurrences(spark: SparkSession, sf: str) -> DataFrame:
    """All claims and citations with their evidence, near matches included."""
    return R.with_near(footnotes(spark, sf).unionByName(editions_claims(spark, sf)))


def claims(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a claim without citation."""
    return complete(table(spark, sf, "documents").select(F.col("doc_id").alias("occurrence"), F.col("text").alias("claim")))


_O = """
WITH l AS (SELECT doc_id, published_on, string_split_regex(coalesce(text, ''), '\\r?\\n') AS ls FROM documents WHERE kind = 'footnotes'), x AS (SELECT doc_id, published_on, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM l),
c AS (SELECT doc_id * 10000 + pos AS occurrence, published_on AS p, regexp_extract(line, '^\\s*\\d+\\.\\s+(.*)$', 1) AS cite FROM x),
o AS (SELECT occurrence, p, cite, nullif(regexp_extract(cite, '(https?://[^\\s,;)]+)', 1), '') AS url, split_part(cite, 'accessed', 1) AS main, CASE WHEN contains(cite, 'accessed') THEN split_part(cite, 'accessed', 2) ELSE '' END AS acc FROM c WHERE cite <> ''),
d AS (SELECT *, list_filter(list_transform(regexp_extract_all(main, '(\\d{1,2}\\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\\s+\\d{4})', 1), lambda x: try_strptime(x, '%d %B %Y')), lambda x: x IS NOT NULL) AS md,
  list_filter(list_transform(regexp_extract_all(acc, '(\\d{1,2}\\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\\s+\\d{4})', 1), lambda x: try_strptime(x, '%d %B %Y')), lambda x: x IS NOT NULL) AS ad FROM o)"""
_RULES = ("source-url-boundary", "source-retrieval", "source-future-date", "access-before-publication", "source-pinpoint-present", "contextual-support")


@query("2.10 rule-3 rule-6 rule-18 rule-19 rule-48 rule-52", _O + """
SELECT occurrence, 'source-url-boundary' AS rule, CASE WHEN url IS NULL THEN 'not_applicable' WHEN regexp_matches(url, '[.,;:)]$') THEN 'candidate' ELSE 'pass' END AS state FROM d
UNION ALL SELECT occurrence, 'source-retrieval', CASE WHEN url IS NULL THEN 'not_applicable' ELSE 'unable' END FROM d
UNION ALL SELECT occurrence, 'source-future-date', CASE WHEN len(md) = 0 OR p IS NULL THEN 'not_applicable' WHEN list_max(md) >= date_trunc('month', p) + INTERVAL 1 MONTH THEN 'candidate' ELSE 'pass' END FROM d
UNION ALL SELECT occurrence, 'access-before-publication', CASE WHEN len(md) = 0 OR len(ad) = 0 THEN 'not_applicable' WHEN list_min(ad) < list_max(md) THEN 'candidate' ELSE 'pass' END FROM d
UNION ALL SELECT occurrence, 'source-pinpoint-present', CASE WHEN url IS NULL THEN 'not_applicable' WHEN regexp_matches(main, '(?i)\\b(?:pp?\\.|pages?)\\s*\\d+') OR regexp_matches(main, '(?i)\\b(?:paragraphs?|paras?\\.?)\\s+\\d+') OR contains(url, '#') THEN 'pass' ELSE 'observation' END FROM d
UNION ALL SELECT occurrence, 'contextual-support', 'unable' FROM d""")
def mechanical_rules_long(spark: SparkSession, sf: str) -> DataFrame:
    return R.screen(footnotes(spark, sf), _RULES)


@query("2.10 A-13 rule-1..56")
def rule_state_counts(spark: SparkSession, sf: str) -> DataFrame:
    """States of every rule over all claims and citations; each rule is there, eligible or not."""
    return R.screen(occurrences(spark, sf)).groupBy("rule", "state").agg(F.count("*").alias("n"))


@query("rule-31 rule-36 rule-37 rule-38 rule-39 rule-40 rule-41 MEC-02 MEC-10 MEC-12 MEC-14 X-22")
def near_quotations(spark: SparkSession, sf: str) -> DataFrame:
    """Quotations of documents that the document before in their source has in nearly the same words, with what differs (tested on its own)."""
    d = beside_previous(table(spark, sf, "documents").select("doc_id", "source", "text"), "source", ["doc_id"], "doc_id", ["text"])
    n = d.select("doc_id", F.explode(Q.near_matches(T.quotations(F.col("text"), first=1_000_000), F.col("previous_text"), F.lit(None).cast("string"))).alias("n"))
    return n.select("doc_id", "n.quote", "n.similarity", "n.changed", "n.form_only")


@query("A-13 A-14 F-25 O-05 SNK-11 ST-08")
def ranked_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates with equal evidence as one question, most urgent rules first."""
    o = occurrences(spark, sf)
    s = R.screen(o).where("state = 'candidate'").join(o.select("occurrence", "cite"), "occurrence")
    g = s.groupBy("rule", F.sha2(F.to_json(F.struct("rule", "cite")), 256).alias("question")).agg(F.count("*").alias("occurrences"), F.min("occurrence").alias("first"))
    return g.withColumn("priority", R.priority(F.col("rule"))).orderBy("priority", "rule", "question")


@query("X-23 rule-44 rule-45 rule-46 rule-50 rule-51")
def claim_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Checks of figures over whole documents."""
    return R.screen(claims(spark, sf), ("percentage-arithmetic", "impossible-percentage", "reversed-range", "table-scope", "legal-scope")).groupBy("rule", "state").agg(F.count("*").alias("n"))


_SHARES = "SELECT s_suppkey, concat(s_nationkey, ' of ', s_suppkey % 13, ' (', CAST(floor(100.0 * s_nationkey / greatest(s_suppkey % 13, 1)) AS BIGINT) + s_suppkey % 3, '%)') AS t FROM {supplier}"


@query("X-23 rule-44", "SELECT s_suppkey, CASE WHEN n2 = 0 THEN 'candidate' WHEN abs(100 * n1 / n2 - p) <= tol THEN 'pass' WHEN n2 <= 10 AND abs(100 * n1 / n2 - p) <= 50 / n2 + tol THEN 'observation' ELSE 'candidate' END AS state FROM (SELECT s_suppkey, CAST(regexp_extract(t, '^(\\d+)', 1) AS DOUBLE) AS n1, CAST(regexp_extract(t, 'of (\\d+)', 1) AS DOUBLE) AS n2, CAST(regexp_extract(t, '\\(([\\d.]+)', 1) AS DOUBLE) AS p, 0.5 + 1e-9 AS tol FROM (" + _SHARES.format(supplier="supplier") + ") v)")
def percentage_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    """Stated shares recomputed; suppliers stand in for statements."""
    return spark.sql(_SHARES, supplier=table(spark, sf, "supplier")).select("s_suppkey", R.worst(R.percentage_states(F.col("t"))).alias("state"))


_ISBNS = "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat('0-', lpad(CAST(p_partkey AS {text}), 8, '0'), '-', CASE p_size % 11 WHEN 10 THEN 'X' ELSE CAST(p_size % 11 AS {text}) END) ELSE concat('978-', lpad(CAST(p_partkey AS {text}), 9, '0'), CAST(p_size % 10 AS {text})) END AS i FROM {part}"


@query("rule-22 rule-23", "SELECT p_partkey, CASE WHEN length(d) = 10 THEN list_sum(list_transform(range(1, 11), lambda k: (11 - k) * CASE WHEN d[k] = 'X' THEN 10 ELSE CAST(d[k] AS INTEGER) END)) % 11 = 0 WHEN length(d) = 13 THEN list_sum(list_transform(range(1, 14), lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE 3 END * CAST(d[k] AS INTEGER))) % 10 = 0 ELSE FALSE END AS valid FROM (SELECT p_partkey, replace(upper(i), '-', '') AS d FROM (" + _ISBNS.format(text="VARCHAR", part="part") + ") v)")
def isbn_checksum(spark: SparkSession, sf: str) -> DataFrame:
    """Check digits of numbers in both lengths; parts stand in for books."""
    return spark.sql(_ISBNS.format(text="STRING", part="{part}"), part=table(spark, sf, "part")).select("p_partkey", R.isbn_valid(F.col("i")).alias("valid"))
