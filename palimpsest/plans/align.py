"""Queries that compare neighbours of a series word by word and block by block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.text import gram_hashes, words
from palimpsest.operators import align as A
from palimpsest.operators.neighbours import beside_previous
from palimpsest.plans.registry import query
from palimpsest.session import once, spread, table

_P = "(SELECT doc_id, text, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM documents)"
_W = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+')"


def doc_pairs(spark: SparkSession, sf: str, *columns: Column) -> DataFrame:
    """Every document with the one before it in its source: `doc_id`, the columns (`text` if none), and `previous_<column>` of the one before."""
    d = table(spark, sf, "documents").select("doc_id", "source", *(columns or ("text",)))
    return beside_previous(d, "source", ["doc_id"], "doc_id", [c for c in d.columns if c not in ("doc_id", "source")])


def edition_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every edition with the one before it of its note: `edition_id`, `body`, `before`."""
    e = once(spread(table(spark, sf, "export_editions").select("edition_id", "note", "first_seen", "body")), "edition_id")
    p = beside_previous(e, "note", ["first_seen", "edition_id"], "edition_id", ["body"])
    return p.where("previous_body IS NOT NULL").select("edition_id", "body", F.col("previous_body").alias("before"))


_ONCE = "SELECT doc_id, gram FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) AS gram FROM (SELECT doc_id, " + _W + " AS w FROM " + _P + ") WHERE len(w) >= 4) GROUP BY ALL HAVING count(*) = 1"


@query("CMP-06 CMP-05", f"SELECT doc_id, count(*) AS anchors FROM ({_ONCE.format('before')}) x JOIN ({_ONCE.format('text')}) y USING (doc_id, gram) GROUP BY doc_id")
def patience_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return A.patience_anchors(doc_pairs(spark, sf), "doc_id", "previous_text", "text", 4).where("anchors > 0")


_BAG = "SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(" + _W + ") AS word FROM " + _P + ") GROUP BY ALL"


@query("CMP-23 CMP-12", f"""
WITH x AS ({_BAG.format('before')}), y AS ({_BAG.format('text')}), c AS (SELECT doc_id, sum(least(x.n, y.n)) AS c FROM x JOIN y USING (doc_id, word) GROUP BY 1), n AS (SELECT doc_id, sum(n) AS n FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY 1)
SELECT n.doc_id, round(2 * coalesce(c, 0) / n.n, 6) AS dice FROM n LEFT JOIN c USING (doc_id)""")
def dice_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of bags of words with the document before; both texts meet in one row."""
    p = doc_pairs(spark, sf).select("doc_id", A.bag_similarity(F.col("previous_text"), F.col("text")).alias("dice"))
    return p.where("dice IS NOT NULL").select("doc_id", F.round("dice", 6).alias("dice"))


_G = "CASE WHEN len({0}) = 0 THEN [] WHEN len({0}) < 5 THEN [array_to_string({0}, ' ')] ELSE list_distinct(list_transform(range(1, len({0}) - 3), lambda i: array_to_string({0}[i:i + 4], ' '))) END"


@query("CMP-29 CMP-30 S-06", f"""
WITH w AS (SELECT doc_id, {_W.format('before')} AS a, {_W.format('text')} AS b FROM {_P}), g AS (SELECT doc_id, {_G.format('a')} AS x, {_G.format('b')} AS y FROM w)
SELECT doc_id, round(CASE WHEN len(y) > 0 THEN len(list_intersect(x, y)) / len(y) END, 4) AS precision, round(CASE WHEN len(x) > 0 THEN len(list_intersect(x, y)) / len(x) END, 4) AS recall FROM g""")
def gram_precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    empty = F.array().cast("array<bigint>")
    p = doc_pairs(spark, sf, gram_hashes(words(F.col("text")), 5).alias("g"))
    return A.gram_scores(p.select("doc_id", F.coalesce("previous_g", empty).alias("x"), F.col("g").alias("y")), "doc_id", "x", "y")


@query("CMP-21 CMP-22 CMP-24 CMP-25 CMP-26 CMP-27 A-27")
def block_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of an edition against the one before: equal, renumbered, split, merged, modified, added, deleted, with words."""
    return A.block_diff(edition_pairs(spark, sf), "edition_id", "before", "body")


@query("CMP-27 A-27")
def diff_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of the block differences by edition, and its number of hunks (runs of changed blocks)."""
    d = A.block_diff(edition_pairs(spark, sf), "edition_id", "before", "body").withColumn("at", F.coalesce("new_at", "old_at"))
    w = Window.partitionBy("edition_id").orderBy("at", F.col("old_at").isNull(), "old_at")
    d = d.withColumn("hunk", ((F.col("kind") != "eq") & (F.coalesce(F.lag("kind").over(w), F.lit("eq")) == "eq")).cast("int"))
    return d.groupBy("edition_id").agg(F.count_if(F.col("kind") == "eq").alias("equal"), F.count_if(F.col("kind").isin("mod", "split", "merge")).alias("modified"), F.count_if(F.col("kind") == "renum").alias("renumbered"), F.count_if(F.col("kind") == "add").alias("added"), F.count_if(F.col("kind") == "del").alias("deleted"), F.sum("added").alias("words_added"), F.sum("deleted").alias("words_deleted"), F.sum("hunk").alias("hunks"))


#: Lengths of longest common subsequences by diagonals: a diagonal follows from the two before it, place by place.
_LCS = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_W.format('before')} AS a, {_W.format('text')} AS b FROM {_P}),
d AS (
  SELECT doc_id, a, b, 0 AS k, list_transform(range(0, len(a) + 1), lambda i: 0) AS p, list_transform(range(0, len(a) + 1), lambda i: 0) AS q FROM w WHERE len(a) > 0 AND len(b) > 0
  UNION ALL
  SELECT doc_id, a, b, k + 1, q, list_transform(range(0, len(a) + 1), lambda i: CASE WHEN i = 0 OR k + 1 - i < 1 OR k + 1 - i > len(b) THEN q[i + 1] WHEN a[i] = b[k + 1 - i] THEN p[i] + 1 ELSE greatest(q[i + 1], q[i]) END)
  FROM d WHERE k < len(a) + len(b)),
c AS (SELECT doc_id, q[len(a) + 1] AS kept FROM d WHERE k = len(a) + len(b))
SELECT doc_id, len(b) - coalesce(kept, 0) AS added, len(a) - coalesce(kept, 0) AS deleted, coalesce(kept, 0) AS kept FROM w LEFT JOIN c USING (doc_id)"""


@query("CMP-07 CMP-08 CMP-17", _LCS)
def word_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Words added, deleted and kept since the document before; kept ones are a longest common subsequence."""
    return doc_pairs(spark, sf).select("doc_id", A.word_changes(F.col("previous_text"), F.col("text")).alias("c")).select("doc_id", "c.*")


def _differences(spark: SparkSession, sf: str) -> tuple[DataFrame, dict[str, Column]]:
    d = A.word_differences(edition_pairs(spark, sf), "edition_id", "before", "body")
    return d, {c: F.col(c) for c in d.columns}


@query("CMP-11 CMP-13 CMP-26 M-24")
def difference_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Differences of wording between neighbouring editions by kind, group, side and size (tested on their own)."""
    d, c = _differences(spark, sf)
    kind = A.difference_kind(c)
    k = d.select(kind.alias("kind"), A.side(c["old_words"], c["new_words"]).alias("side"), A.difference_size(c["old_words"], c["new_words"]).alias("size"), F.size("old_words").alias("old"), F.size("new_words").alias("new"))
    return k.groupBy("kind", A.difference_group(F.col("kind")).alias("kinds"), "side", "size").agg(F.count("*").alias("differences"), F.sum("old").alias("old_words"), F.sum("new").alias("new_words"))


@query("CMP-10 CMP-14 CMP-03")
def difference_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Each difference judged by independent readings of the two bodies: real, artefact or unresolved, and whether the second reader agrees.

    The second reading takes the visible text without its blocks. (Tested on its own.)
    """
    pairs = edition_pairs(spark, sf)
    d = A.word_differences(pairs, "edition_id", "before", "body")
    reading = lambda c: A.padded(words(T.visible_text(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "(?i)</?(?:p|li|h[1-6]|td|th|tr|ul|ol|table|div|br)[^>]*>", " "))))
    texts = pairs.select(F.col("edition_id").alias("id"), reading("before").alias("old_text"), reading("body").alias("new_text"))
    j = d.join(texts, F.col("edition_id") == F.col("id"))
    c = {x: F.col(x) for x in d.columns}
    v = j.select(A.side(c["old_words"], c["new_words"]).alias("side"), A.verdict(c, F.col("old_text"), F.col("new_text")).alias("verdict"), A.second_opinion(c, F.col("new_text")).alias("second_reader"))
    return v.groupBy("side", "verdict", "second_reader").agg(F.count("*").alias("differences"))


@query("CMP-16")
def paragraph_map(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of paragraphs of an edition's predecessor and those of their counterparts in it (tested on its own)."""
    return A.paragraph_numbers(edition_pairs(spark, sf), "edition_id", "before", "body")


@query("CMP-13 CMP-31")
def difference_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks by kind and by how many of their words changed: none, word, words, passage."""
    d = A.block_diff(edition_pairs(spark, sf), "edition_id", "before", "body")
    most = F.greatest("added", "deleted")
    return d.select("edition_id", "kind", F.when(F.col("kind") == "eq", "none").when(most <= 1, "word").when(most <= 4, "words").otherwise("passage").alias("size")).groupBy("kind", "size").agg(F.count("*").alias("blocks"))


@query("CMP-28 X-17 CMP-01")
def heading_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Headings of an edition found again, in order, in the edition before."""
    return edition_pairs(spark, sf).select("edition_id", A.heading_changes(F.col("before"), F.col("body")).alias("h")).select("edition_id", "h.*")


@query("CMP-09 CMP-12 M-25")
def changed_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Changed blocks adjudicated: moved (their words stand elsewhere in the other edition) or real; in the opening or later."""
    d = A.changed_passages(edition_pairs(spark, sf), "edition_id", "before", "body")
    verdict = F.when(F.col("moved"), "moved").when(F.col("words") == 0, "markup").otherwise("real")
    return d.groupBy("kind", verdict.alias("verdict"), "opening").agg(F.count("*").alias("blocks"), F.sum("words").alias("words"))
