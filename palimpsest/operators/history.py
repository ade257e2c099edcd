"""History of changing attributes: periods in which an entity's attributes held without change.

Co-partitioned, key-sorted input: rows are range-partitioned by (entity, time) and sorted within partitions, so the executors' external sort
merges the k sorted runs (spilled or not) of each partition into one ordered stream. `mapInArrow` walks that stream and emits a version
whenever the attributes change; it holds one state, never a history. Range partitions split an entity of any size: partitions hand the
last stated attributes on through one summary row each, and at most two versions a partition (its first and its open last) are closed afterwards.

Several sources (snapshots, updates) are merged by passing their union: only key, time, tie-break and attributes are read.

Defined cases: rows with a null entity or time don't count; of several rows with one entity and time the one received last counts (null:
earliest; then the greater attributes); a null attribute isn't stated and the last stated one holds on; a period whose attributes were never
stated has null ones; the last period of an entity ends at `END`.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import checkpoint

END = "9999-12-31T23:59:59Z"
ROWS_A_PARTITION = 500_000


def periods(df: DataFrame, entity: str, at: Column, received: Column, attributes: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """`entity`, `from_us`, `to_us` (null: open) and the attributes of every period. `at`: long microseconds. Attributes must be strings or longs."""
    spark = df.sparkSession
    names = list(attributes)
    src = df.select(F.col(entity).alias("k"), at.alias("at"), received.alias("rec"), *[c.alias(f"a{i}") for i, c in enumerate(attributes.values())]).where("k IS NOT NULL AND at IS NOT NULL")
    attr = [f"a{i}" for i in range(len(names))]
    # one row for each entity and time: partial maxima are merged before the shuffle
    src = src.groupBy("k", "at").agg(F.max(F.struct("rec", *attr)).alias("m")).select("k", "at", *[F.col(f"m.{a}").alias(a) for a in attr])
    n = partitions or max(spark.sparkContext.defaultParallelism, df.count() // ROWS_A_PARTITION + 1)
    ordered = checkpoint(src.repartitionByRange(n, "k", "at").sortWithinPartitions("k", "at").withColumn("p", F.spark_partition_id()))
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}

    def walk(batches, start, emit):
        """Calls `emit(key, at, attributes, new key)` at each change; returns the last state. `start`: state of the partitions before, by partition."""
        state = None
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for row in zip(*cols, strict=True):
                key, t, now, p = row[0], row[1], row[2:-1], row[-1]
                if state is None:
                    state = start.get(p)
                same = state is not None and state[0] == key
                full = tuple(x if x is not None else y for x, y in zip(now, state[1], strict=True)) if same else now
                if not same or full != state[1]:
                    emit(key, t, full, p)
                state = (key, full)
        return state

    def summary(batches):
        """First and last key of the partition and the last stated attributes of the last key within it."""
        first = p = None
        last: list = []

        def watched():
            nonlocal first, p
            for b in batches:
                if first is None and b.num_rows:
                    first, p = b.column(0)[0].as_py(), b.column(b.num_columns - 1)[0].as_py()
                yield b

        state = walk(watched(), {}, lambda *x: None)
        if state is not None:
            last = [state[0], *state[1]]
            yield pa.RecordBatch.from_pylist([{"p": p, "first": first, "last": last[0], **dict(zip(attr, last[1:], strict=True))}], schema=summary_schema)

    arrow = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}
    summary_schema = pa.schema([("p", pa.int32()), ("first", arrow[kinds["k"]]), ("last", arrow[kinds["k"]]), *[(a, arrow[kinds[a]]) for a in attr]])
    ddl = f"p int, first {kinds['k']}, last {kinds['k']}, " + ", ".join(f"{a} {kinds[a]}" for a in attr)
    # one row a partition: the driver passes the states on
    start, carry = {}, None
    for r in sorted(ordered.mapInArrow(summary, ddl).collect(), key=lambda r: r.p):
        if carry is not None:
            start[r.p] = carry
        here = tuple(r[a] for a in attr)
        if carry is not None and r.last == carry[0]:
            here = tuple(x if x is not None else y for x, y in zip(here, carry[1], strict=True))
        carry = (r.last, here)

    out_schema = pa.schema([("k", arrow[kinds["k"]]), ("from_us", pa.int64()), ("to_us", pa.int64()), ("edge", pa.bool_()), *[(a, arrow[kinds[a]]) for a in attr]])
    out_ddl = f"k {kinds['k']}, from_us long, to_us long, edge boolean, " + ", ".join(f"{a} {kinds[a]}" for a in attr)

    def versions(batches):
        open_row, done, firsts = None, [], 0

        def emit(key, t, full, p):
            nonlocal open_row, firsts
            if open_row is not None:
                closed = open_row[0] == key
                # the first version of a partition may close the open one of the partition before
                done.append((open_row[0], open_row[1], t if closed else None, open_row[3], *open_row[4]))
            open_row = (key, t, None, firsts == 0, full)
            firsts += 1

        def table():
            rows, done[:] = done[:], []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out_schema, strict=True)], schema=out_schema)

        state = None
        for b in batches:
            if b.num_rows:
                state = walk([b], start if state is None else {b.column(b.num_columns - 1)[0].as_py(): state}, emit)
            if len(done) > 20_000:
                yield table()
        if open_row is not None:
            done.append((open_row[0], open_row[1], None, True, *open_row[4]))
        if done:
            yield table()

    found = ordered.mapInArrow(versions, out_ddl)
    inner = found.where("NOT edge").select("k", "from_us", "to_us", *attr)
    # at most two rows a partition
    w = Window.partitionBy("k").orderBy("from_us")
    edges = found.where("edge").withColumn("to_us", F.coalesce("to_us", F.lead("from_us").over(w))).select("k", "from_us", "to_us", *attr)
    out = inner.unionByName(edges)
    return out.select(F.col("k").alias(entity), "from_us", "to_us", *[F.col(a).alias(x) for a, x in zip(attr, names, strict=True)])


def iso_seconds(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def title_periods(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Periods of `title_log`: titles without blanks and line ends at either end, dates as instants."""
    us = lambda c: F.unix_micros(F.col(c).try_cast("timestamp"))
    title = F.regexp_replace("title", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return periods(df, "edition_id", us("at"), F.unix_micros(F.col("received_at").cast("timestamp")), {"title": title, "dated_us": us("public_updated_at")}, partitions)


def title_history(df: DataFrame, partitions: int | None = None) -> DataFrame:
    p = title_periods(df, partitions)
    return p.select("edition_id", iso_seconds(F.col("from_us")).alias("valid_from"), F.coalesce(iso_seconds(F.col("to_us")), F.lit(END)).alias("valid_to"))


TITLE_HISTORY_SQL = """
WITH r AS (
  SELECT edition_id, CAST("at" AS TIMESTAMPTZ) AS t, received_at, regexp_replace(title, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS title, CAST(public_updated_at AS TIMESTAMPTZ) AS d
  FROM title_log WHERE edition_id IS NOT NULL AND "at" IS NOT NULL),
one AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY edition_id, t ORDER BY received_at DESC NULLS LAST, title DESC NULLS LAST, d DESC NULLS LAST) = 1),
held AS (SELECT edition_id, t, last_value(title IGNORE NULLS) OVER w AS title, last_value(d IGNORE NULLS) OVER w AS d, row_number() OVER w AS i FROM one WINDOW w AS (PARTITION BY edition_id ORDER BY t)),
starts AS (SELECT * FROM held QUALIFY i = 1 OR title IS DISTINCT FROM lag(title) OVER (PARTITION BY edition_id ORDER BY t) OR d IS DISTINCT FROM lag(d) OVER (PARTITION BY edition_id ORDER BY t))
SELECT edition_id, strftime(t AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS valid_from,
  coalesce(strftime((lead(t) OVER (PARTITION BY edition_id ORDER BY t)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ'), '9999-12-31T23:59:59Z') AS valid_to FROM starts"""
