"""Stateful operators on streams. Each gives, once its input has ended, what its batch twin gives on the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.operators.state import merge_batch


def rate_limit(events: DataFrame, key: str, at: str, span: str, most: int, late: str = "1 hour") -> DataFrame:
    """Writes a key made in each fixed window, and those beyond the limit; windows close when the watermark passes."""
    w = F.window(at, span)
    return events.withWatermark(at, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("writes")).select(key, F.col("w.start").alias("start"), "writes", F.greatest(F.col("writes") - most, F.lit(0)).alias("refused"))


def latest_into(stream: DataFrame, key: str, at: str, value: Column, path: str, checkpoint: str):
    """Keeps the newest value of each key in a table: every batch is merged into the version before, under its own number.

    A batch that is repeated after a failure writes the same version again, so the result is the same.
    """
    spark: SparkSession = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.groupBy(key).agg(F.max(F.struct(F.col(at).alias("at"), value.alias("value"))).alias("m")).select(key, "m.*")
        if number == 0:
            new.write.mode("overwrite").parquet(f"{path}/0")
            return
        old = spark.read.parquet(f"{path}/{number - 1}")
        # a late row of an older time doesn't win over the stored one
        both = old.unionByName(new).groupBy(key).agg(F.max(F.struct("at", "value")).alias("m")).select(key, "m.*")
        merge_batch(old, both, key).select(key, "at", "value").write.mode("overwrite").parquet(f"{path}/{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def versions(events: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Change points of each key as they come: `key`, `at`, `value` whenever the value differs from the one before.

    Rows of a key are taken in order of time within a batch; the state is the last value alone.
    """
    schema = f"{key} long, {at} timestamp, {value} string"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        first = not state.exists
        rows = pd.concat(list(batches)).sort_values(at, kind="stable")
        out = []
        for t, v in zip(rows[at], rows[value], strict=True):
            if first or v != last:
                out.append((k[0], t, v))
                last, first = v, False
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, at, value])

    return events.groupBy(key).applyInPandasWithState(step, schema, "last string", "append", GroupStateTimeout.NoTimeout)


def revisions(writes: DataFrame, key: str, order: str, expected: str) -> DataFrame:
    """Optimistic writes: one lands if it expects the key's present revision. The state is that number."""
    schema = f"{key} long, {order} long, landed boolean, revision long"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rev = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for o, e in zip(rows[order], rows[expected], strict=True):
            landed = bool(e == rev)
            rev += landed
            out.append((k[0], int(o), landed, int(rev)))
        state.update((int(rev),))
        yield pd.DataFrame(out, columns=[key, order, "landed", "revision"])

    return writes.groupBy(key).applyInPandasWithState(step, schema, "rev long", "append", GroupStateTimeout.NoTimeout)


def failure_runs(events: DataFrame, key: str, at: str, failed: str, most: int = 8) -> DataFrame:
    """A row when a key has failed `most` times on end: the guard that stops asking. The state is the length of the present run."""
    schema = f"{key} long, {at} timestamp"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(at, kind="stable")
        out = []
        for t, f in zip(rows[at], rows[failed], strict=True):
            run = run + 1 if f else 0
            if run == most:
                out.append((k[0], t))
        state.update((int(run),))
        yield pd.DataFrame(out, columns=[key, at])

    return events.groupBy(key).applyInPandasWithState(step, schema, "run long", "append", GroupStateTimeout.NoTimeout)
