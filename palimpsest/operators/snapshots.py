"""What changed between consecutive full snapshots.

Rows are reduced in the JVM to compact keys: a hash of the entity, a hash of the compared values and one ordered instant. These go once
through a shuffle by hash bucket. In each bucket numpy sorts the keys of all snapshots and finds additions, removals and changes between a
snapshot and the one delivered before it by `searchsorted`. Full values are retrieved afterwards, for the differing keys only.

A bucket holds all snapshots of its entities, so its size follows the number of rows a bucket, not a snapshot, country or entity; a
bucket's number of rows is kept near ROWS_A_BUCKET by their count. Late rows need no care: they carry the number of their snapshot.

Defined cases: rows with a null snapshot number or entity belong to no snapshot and are left out; of several rows with one key the last
delivered counts (a null delivery time is the earliest; among rows delivered at one instant the one with the larger row hash); null values
are values; the first snapshot has no changes; an empty table has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.session import written

ROWS_A_BUCKET = 400_000
#: Differing keys up to this number go to every executor; more are joined by a shuffle of the keys and texts.
BROADCAST_DIFFERING = 1_000_000
#: Snapshot numbers go to the driver; a weekly delivery makes 52 a year.
MOST_SNAPSHOTS = 1_000_000
NULL = np.iinfo(np.int64).min
NAMES = np.array(["added", "removed", "changed"])


def instant_us(iso: Column) -> Column:
    """Microseconds of an ISO 8601 stamp with its zone stated; null if it is none."""
    return F.unix_micros(iso.try_cast("timestamp"))


def last_of_each(snap: np.ndarray, key: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Indices, sorted by snapshot and key, of the row that counts for each (snapshot, key)."""
    order = np.lexsort((row, at, key, snap))
    s, k = snap[order], key[order]
    last = np.ones(len(order), bool)
    last[:-1] = (s[1:] != s[:-1]) | (k[1:] != k[:-1])
    return order[last]


def differences(snap: np.ndarray, key: np.ndarray, row: np.ndarray, seen: np.ndarray, before: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(snapshot, key, kind, snapshot that has the full values) of each difference. The input is sorted by snapshot and key, keys are unique in each."""
    out = []
    numbers = np.array(sorted({*before, *before.values()}), np.int64)
    lo, hi = np.searchsorted(snap, numbers), np.searchsorted(snap, numbers, side="right")
    span = {int(n): slice(a, b) for n, a, b in zip(numbers, lo, hi, strict=True)}
    for now, old in before.items():
        a, b = span[old], span[now]
        ka, kb = key[a], key[b]
        at = np.searchsorted(ka, kb)
        inside = at < len(ka)
        common = np.zeros(len(kb), bool)
        common[inside] = ka[at[inside]] == kb[inside]
        gone = np.ones(len(ka), bool)
        gone[at[common]] = False
        i, j = at[common], np.flatnonzero(common)
        sa, sb = seen[a][i], seen[b][j]
        # last seen: gone back, or null on one side only; NULL is the smallest number
        differs = (row[a][i] != row[b][j]) | (sb < sa) | ((sa == NULL) != (sb == NULL))
        for k, kind, where in ((kb[~common], 0, now), (ka[gone], 1, old), (kb[j[differs]], 2, now)):
            out.append((np.full(len(k), now, np.int64), k, np.full(len(k), kind, np.int8), np.full(len(k), where, np.int64)))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int8, np.int64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def changes(df: DataFrame, snapshot: str, entity: str, compared: Column, seen: Column, delivered: Column, buckets: int | None = None) -> DataFrame:
    """`snapshot`, `entity`, `change` (added, removed, changed) against the snapshot delivered before.

    `compared`: hash or value whose difference is a change. `seen`: long that may only move on; its going back, or to or from null, is a change.
    """
    rows = df.where(F.col(snapshot).isNotNull() & F.col(entity).isNotNull())
    counts = rows.groupBy(snapshot).count().limit(MOST_SNAPSHOTS + 1).collect()
    if len(counts) > MOST_SNAPSHOTS:
        raise ValueError("too many snapshot numbers")
    numbers = sorted(r[0] for r in counts)
    before = {int(b): int(a) for a, b in zip(numbers, numbers[1:], strict=False)}
    n = buckets or max(df.sparkSession.sparkContext.defaultParallelism, sum(r[1] for r in counts) // ROWS_A_BUCKET + 1)
    keys = rows.select(
        F.pmod(F.hash(entity), F.lit(n)).alias("bucket"), F.col(snapshot).cast("long").alias("snap"), F.xxhash64(entity).alias("key"),
        F.xxhash64(compared).alias("row"), F.coalesce(seen, F.lit(int(NULL))).alias("seen"), F.coalesce(F.unix_micros(delivered.cast("timestamp")), F.lit(int(NULL))).alias("at"),
    )

    def run(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        snap, key, row, seen_us, at = (t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("snap", "key", "row", "seen", "at"))
        keep = last_of_each(snap, key, at, row)
        s, k, kind, where = differences(snap[keep], key[keep], row[keep], seen_us[keep], before)
        return pa.table({"bucket": pa.array(np.full(len(s), bucket, np.int32)), "snap": pa.array(s), "key": pa.array(k), "change": pa.array(NAMES[kind].tolist(), pa.string()), "valued": pa.array(where)})

    found = written(keys.groupBy("bucket").applyInArrow(run, "bucket int, snap long, key long, change string, valued long"), "differences")
    # full values, for the differing keys only: the entity's text by its hashes. Texts of other keys aren't moved.
    differing = found.select(F.col("bucket").alias("b"), F.col("key").alias("k")).distinct()
    if differing.limit(BROADCAST_DIFFERING + 1).count() <= BROADCAST_DIFFERING:
        differing = F.broadcast(differing)
    texts = rows.select(F.pmod(F.hash(entity), F.lit(n)).alias("bucket_"), F.xxhash64(entity).alias("key_"), F.col(entity))
    named = texts.join(differing, (F.col("bucket_") == F.col("b")) & (F.col("key_") == F.col("k")), "left_semi").distinct()
    out = found.join(named, (F.col("bucket") == F.col("bucket_")) & (F.col("key") == F.col("key_")))
    return out.select(F.col("snap").cast(df.schema[snapshot].dataType).alias(snapshot), F.col(entity), "change")


def note_changes(df: DataFrame, buckets: int | None = None) -> DataFrame:
    """Changes of `note_snapshots`: by text hash (case of digits aside), first_seen as an instant, last_seen by its rules."""
    compared = F.struct(F.lower("text_sha256"), instant_us(F.col("first_seen")), F.when(instant_us(F.col("first_seen")).isNull(), F.col("first_seen")))
    return changes(df, "snapshot_no", "note", compared, instant_us(F.col("last_seen")), F.col("delivered_at"), buckets)


NOTE_CHANGES_SQL = """
WITH last AS (
  SELECT snapshot_no, note, lower(text_sha256) AS h, CAST(first_seen AS TIMESTAMPTZ) AS f, CAST(last_seen AS TIMESTAMPTZ) AS l FROM note_snapshots
  WHERE snapshot_no IS NOT NULL AND note IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, note ORDER BY delivered_at DESC NULLS LAST, text_sha256, first_seen, last_seen) = 1),
numbers AS (SELECT snapshot_no AS n, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS p FROM (SELECT DISTINCT snapshot_no FROM last)),
pairs AS (
  SELECT x.n AS snapshot_no, b.note AS nb, a.note AS na, a.h AS ah, b.h AS bh, a.f AS af, b.f AS bf, a.l AS al, b.l AS bl
  FROM (SELECT n, p, note FROM numbers JOIN (SELECT DISTINCT snapshot_no, note FROM last) t ON t.snapshot_no IN (n, p) WHERE p IS NOT NULL GROUP BY ALL) x
  LEFT JOIN last a ON a.snapshot_no = x.p AND a.note = x.note LEFT JOIN last b ON b.snapshot_no = x.n AND b.note = x.note)
SELECT snapshot_no, coalesce(nb, na) AS note, CASE WHEN na IS NULL THEN 'added' WHEN nb IS NULL THEN 'removed' ELSE 'changed' END AS change FROM pairs
WHERE na IS NULL OR nb IS NULL OR ah IS DISTINCT FROM bh OR af IS DISTINCT FROM bf OR bl < al OR (al IS NULL) <> (bl IS NULL)"""
