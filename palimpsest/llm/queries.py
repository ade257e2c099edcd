"""Queries of the text operators and the SQL they are compared with, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, lookalike, mixing, neardup, subjects
from palimpsest.session import table

#: Similarity that TESTDATA.md sets for editions.
EDITION_THRESHOLD = 0.5


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.edition_pairs(*neardup.class_links(table(spark, sf, "export_editions"), "edition_id", "text_sha256", "body", EDITION_THRESHOLD))


def p1_members(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each edition: its class of equal phrase sets. With `p1_links` this holds all that `p1_found` expands into pairs."""
    return neardup.member_rows(neardup.class_sets(table(spark, sf, "export_editions"), "edition_id", "text_sha256", "body")[0])


def p1_links(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of classes with a similarity of at least 0.5, by their smallest editions."""
    return neardup.link_rows(*neardup.class_links(table(spark, sf, "export_editions"), "edition_id", "text_sha256", "body", EDITION_THRESHOLD))


def p1_classes(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each edition: its class of equal phrase sets and the class's number of links at 0.8."""
    return neardup.classes(*neardup.class_links(table(spark, sf, "export_editions"), "edition_id", "text_sha256", "body", 0.8))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    editions, titles = table(spark, sf, "export_editions"), table(spark, sf, "official_titles")
    return lookalike.title_twins(editions, titles).unionByName(lookalike.body_twins(editions, titles))


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each edition: the group of editions whose bodies look the same. `p5_found` expands the groups into pairs."""
    return lookalike.body_groups(table(spark, sf, "export_editions"), table(spark, sf, "official_titles"))


def p5_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Every edition's title in one consistent form."""
    return lookalike.normalised_titles(table(spark, sf, "export_editions"), table(spark, sf, "official_titles"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode(table(spark, sf, "documents"))


def p6_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every document."""
    return bpe.token_counts(table(spark, sf, "documents"))


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of the mixture with their uses."""
    return mixing.mix(mixing.counted(table(spark, sf, "documents")), table(spark, sf, "mix_targets"))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The share that each source reached."""
    return mixing.shares(mixing.counted(table(spark, sf, "documents")), table(spark, sf, "mix_targets"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.subjects(table(spark, sf, "documents"), table(spark, sf, "subject_samples"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """How much of the corpus deals with each subject: documents and their mean share of sentences."""
    found = subjects.subject_shares(table(spark, sf, "documents"), table(spark, sf, "subject_samples"))
    return found.groupBy("subject").agg(F.count("*").alias("documents"), F.avg("share").alias("mean_share"))


QUERIES = {
    "p1_found": p1_found, "p1_links": p1_links, "p1_members": p1_members, "p1_classes": p1_classes, "p5_found": p5_found, "p5_titles": p5_titles, "p5_groups": p5_groups, "p6_ids": p6_ids, "p6_lengths": p6_lengths,
    "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_shares": p8_shares,
}
SQL: dict[str, str] = {}
