"""Search queries: index, facets, passages, groups, find in text, glossary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import search as S
from palimpsest.plans.registry import query
from palimpsest.session import table

_W = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"


@query("SRC-02 A-20 M-51", f"SELECT word, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM (SELECT doc_id, unnest({_W}) AS word FROM documents) GROUP BY word HAVING count(DISTINCT doc_id) > 1")
def word_index(spark: SparkSession, sf: str) -> DataFrame:
    i = S.inverted_index(table(spark, sf, "documents"), "doc_id", "text")
    return i.groupBy("word").agg(F.count("*").alias("documents"), F.sum("n").alias("occurrences")).where("documents > 1")


_HIT = "regexp_matches(lower(coalesce(text, '')), '(?:^|[^\\p{L}\\p{N}])access') AND regexp_matches(lower(coalesce(text, '')), '(?:^|[^\\p{L}\\p{N}])depend')"


@query("A-20 M-47", f"""
WITH h AS (SELECT country, kind FROM documents WHERE {_HIT})
SELECT 'a' AS facet, country AS value, count(*) AS n FROM h WHERE kind IN ('note', 'letter') GROUP BY ALL UNION ALL SELECT 'b', kind, count(*) FROM h WHERE country IN ('Maravel', 'Quarrin') GROUP BY ALL UNION ALL SELECT 'all', NULL, n FROM (SELECT count(*) AS n FROM h WHERE kind IN ('note', 'letter') AND country IN ('Maravel', 'Quarrin')) WHERE n > 0""")
def facet_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Countries counted under the chosen kinds, kinds under the chosen countries, the total under both."""
    h = table(spark, sf, "documents").where(S.starts_words(F.coalesce("text", F.lit("")), ["access", "depend"]))
    return S.facets(h, F.col("country"), F.col("kind"), ["Maravel", "Quarrin"], ["note", "letter"])


@query("O-07 X-28 M-46", "SELECT title_id, title FROM official_titles WHERE country IN ('Maravel') AND regexp_matches(lower(title), '(?:^|[^\\p{L}\\p{N}])prison')")
def report_search(spark: SparkSession, sf: str) -> DataFrame:
    """'latest prison note about Maravel': the soft word 'latest' is dropped, as no title has it."""
    t = table(spark, sf, "official_titles")
    q = S.parse("latest prison note about Maravel", ["Maravel", "Quarrin", "Grünwald Republic"])
    return S.match(t, q, F.col("title"), F.col("country")).select("title_id", "title")


@query("O-07 M-57 A-16", f"SELECT source, doc_id, place, hits FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS place, count(*) OVER (PARTITION BY source) AS hits FROM documents WHERE {_HIT}) WHERE place <= 5")
def grouped_results(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "documents").where(S.starts_words(F.coalesce("text", F.lit("")), ["access", "depend"]))
    return S.grouped_hits(h, "source", [F.col("n_chars").asc_nulls_last(), F.col("doc_id")], 5).select("source", "doc_id", F.col("place").cast("long").alias("place"), "hits")


_FLAT = "lower(trim(regexp_replace(coalesce(text, ''), '[\\s\\p{Z}]+', ' ', 'g')))"


@query("M-53 M-54 F-16 X-32", f"SELECT doc_id, (length(f) - length(replace(f, 'earlier edition', ''))) // 15 AS hits, instr(f, 'earlier edition') AS first_at FROM (SELECT doc_id, {_FLAT} AS f FROM documents) WHERE contains(f, 'earlier edition')")
def find_in_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences of a phrase whatever the white space, and the first place."""
    d = table(spark, sf, "documents").select("doc_id", F.lower(T.collapsed(F.coalesce("text", F.lit("")))).alias("f")).where(F.contains("f", F.lit("earlier edition")))
    n = (F.length("f") - F.length(F.replace("f", F.lit("earlier edition"), F.lit("")))) / 15
    return d.select("doc_id", n.cast("long").alias("hits"), F.instr("f", F.lit("earlier edition")).cast("long").alias("first_at"))


@query("O-10", """
WITH t AS (SELECT DISTINCT topic FROM official_titles), s AS (SELECT topic, CASE WHEN topic = 'land disputes' THEN 3 WHEN starts_with(topic, 'land') THEN 2 WHEN contains(topic, 'disputes') THEN 1 ELSE 0 END AS score FROM t)
SELECT topic, score, count(*) OVER () > 3 AS more FROM s WHERE score > 0 ORDER BY score DESC, topic LIMIT 3""")
def glossary_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Scored matches: whole, beginning, inside; the first three, and whether there are more."""
    t = table(spark, sf, "official_titles").select("topic").distinct()
    score = F.when(F.col("topic") == "land disputes", 3).when(F.col("topic").startswith("land"), 2).when(F.contains("topic", F.lit("disputes")), 1).otherwise(0)
    s = t.withColumn("score", score).where("score > 0")
    n = s.agg((F.count("*") > 3).alias("more"))
    return s.orderBy(F.desc("score"), "topic").limit(3).join(F.broadcast(n))


@query("X-29 A-17", "SELECT grp, count(DISTINCT country) AS countries, count(*) AS titles FROM (SELECT country, unnest(regexp_split_to_array(topic, ' and | or |, ')) AS grp FROM official_titles) GROUP BY grp")
def topic_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Topics that name several things belong to each of them."""
    t = table(spark, sf, "official_titles").select("country", F.explode(F.split("topic", " and | or |, ")).alias("grp"))
    return t.groupBy("grp").agg(F.countDistinct("country").alias("countries"), F.count("*").alias("titles"))


_SECTION = "unnest(regexp_extract_all(coalesce(body, ''), '(?is)<h2[^>]*>(.*?)</h2>', 1))"


@query("X-14 X-13 M-38", f"SELECT heading, count(*) AS sections FROM (SELECT edition_id, {_SECTION} AS heading FROM (SELECT DISTINCT ON (edition_id) * FROM export_editions)) GROUP BY heading")
def sections(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "export_editions").dropDuplicates(["edition_id"])
    return e.select(F.explode(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit("(?is)<h2[^>]*>(.*?)</h2>"), F.lit(1))).alias("heading")).groupBy("heading").agg(F.count("*").alias("sections"))
