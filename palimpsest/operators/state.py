"""Stateful operators in batch; `palimpsest.streaming` has their twins on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.neighbours import ranges, with_running_sum


def latest(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """`key`, `at`, `value` of the newest row of each key (ties: the greater value, null least)."""
    m = F.max(F.struct(F.col(at).alias("at"), F.coalesce(F.col(value), F.lit("")).alias("o"), F.col(value).alias("value")))
    return df.groupBy(key).agg(m.alias("m")).select(key, F.col("m.at").alias("at"), F.col("m.value").alias("value"))


def merge_batch(stored: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """`key`, `action`, `at`, `value`: idempotent upsert of a batch of latest rows; nothing is removed."""
    o = stored.select(F.col(key).alias("k"), F.col("at").alias("oa"), F.col("value").alias("ov"), F.lit(1).alias("o"))
    b = batch.select(F.col(key).alias("k"), F.col("at").alias("ba"), F.col("value").alias("bv"), F.lit(1).alias("b"))
    j = o.join(b, "k", "full")
    action = F.when(F.col("o").isNull(), "inserted").when(F.col("b").isNull(), "kept").when(~F.col("bv").eqNullSafe(F.col("ov")), "updated").otherwise("seen")
    return j.select(F.col("k").alias(key), action.alias("action"), F.greatest("oa", "ba").alias("at"), F.when(F.col("b").isNull(), F.col("ov")).otherwise(F.col("bv")).alias("value"))


def revisions(df: DataFrame, key: str, order: list[str], expected: str) -> DataFrame:
    """Optimistic concurrency: a write lands if the revision it expects is the key's present one; `landed`, `revision` after it.

    Writes are folded in order in a key. The fold is a running aggregate over the key's list of (order, expected); keys with unbounded
    histories belong to the streaming twin, which keeps one number a key.
    """
    w = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, expected))).alias("ws"))
    step = lambda s, x: F.when(s["rev"] == x[expected], F.struct((s["rev"] + 1).alias("rev"), F.array_append(s["log"], F.lit(True)).alias("log"))).otherwise(F.struct(s["rev"].alias("rev"), F.array_append(s["log"], F.lit(False)).alias("log")))
    start = F.struct(F.lit(0).cast("long").alias("rev"), F.array().cast("array<boolean>").alias("log"))
    return w.select(key, F.aggregate("ws", start, step).alias("s")).select(key, F.col("s.rev").alias("revision"), F.size(F.filter("s.log", lambda b: b)).cast("long").alias("landed"), F.size("s.log").cast("long").alias("writes"))


def within_budget(df: DataFrame, order: list[str], size: str, budget: float, block: str) -> DataFrame:
    """Rows in order until the running sum passes the budget: sums by block first, so no global sort meets one task."""
    sums = df.groupBy(block).agg(F.sum(size).alias("__s")).withColumn("__all", F.lit(0))
    # running sums of the blocks by ranges of them: blocks may be as many as rows
    before = with_running_sum(ranges(sums, "__all", [block], ["__s"]), "__all", [block], "__s", "__t").select(F.col(block), (F.col("__t") - F.col("__s")).alias("__b"))
    j = df.join(before, block)
    inner = F.sum(size).over(Window.partitionBy(block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return j.withColumn("running", F.col("__b") + inner).where(F.col("running") <= budget).drop("__b")
