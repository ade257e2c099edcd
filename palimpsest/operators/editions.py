"""Operators on series of editions: similarity to the one before, runs of equal texts, leaving the source, merging captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import gram_hashes, kept_share, words
from palimpsest.operators.neighbours import beside_previous, ranges, with_previous, with_running_sum


def similarity_to_previous(df: DataFrame, series: str, order: str, text: str, n: int = 5) -> DataFrame:
    """`order`, `series`, `previous`, `similarity` (null on the first). `order` is the key. Phrases are sets of hashes, compared inside the row."""
    g = df.select(order, series, gram_hashes(words(F.col(text)), n).alias("g"))
    p = beside_previous(g, series, [order], order, [series, "g"])
    return p.select(order, series, "previous", F.when(F.col("previous").isNotNull(), kept_share(F.col("g"), F.col("previous_g"))).alias("similarity"))


def collapse_copies(df: DataFrame, series: str, order: str, fingerprint: str, rank: Column) -> DataFrame:
    """Only adjacent equal texts merge (A, B, A stays three); the copy with the highest rank is kept."""
    light = df.select(series, order, F.col(fingerprint).alias("print"), rank.alias("rank"))
    r = with_previous(ranges(light, series, [order], ["print", "rank"]), series, [order], ["print"])
    f = r.withColumn("new", F.when(~F.col("first") & (F.col("print") == F.col("previous_print")), 0).otherwise(1))
    f = with_running_sum(f, series, [order], "new", "run")
    return f.groupBy(series, "run").agg(F.max_by(order, "rank").alias("kept"), F.min(order).alias("first_doc"), F.count("*").alias("copies")).drop("run")


def left_source(df: DataFrame, key: str, edition: str, seen: str, live: Column) -> DataFrame:
    """When the next live edition of the note was first seen after this one; null for the last one and for copies."""
    w = Window.partitionBy(key).orderBy(seen, edition).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn("left_at", F.when(live, F.min(F.when(live, F.col(seen))).over(w)))


def change_points(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Rows at which any of the values differs from the row before (nulls are values)."""
    w = Window.partitionBy(key).orderBy(*order)
    now, before = F.struct(*values), F.lag(F.struct(*values)).over(w)
    return df.withColumns({"__b": before, "__n": F.row_number().over(w)}).where((F.col("__n") == 1) | ~now.eqNullSafe(F.col("__b"))).drop("__b", "__n")
