"""Rows of many series in order, without a window over a series: a series may hold any part of the rows.

Light rows (series, order, what is compared) are range-partitioned by series and order and written once with the number of their range. In a
range, windows see at most its rows; ranges hand on one row each (the last one, or a running sum by series), so nothing follows the size
of a series. Wide columns are joined to pairs of keys afterwards.

Defined cases: null series form one series; a null order comes first; keys must be unique; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import written

ROWS_A_RANGE = 500_000
#: Rows with whole texts in a partition.
WIDE_ROWS = 50_000


def ranges(df: DataFrame, series: str, order: list[str], take: list[str], partitions: int | None = None) -> DataFrame:
    """`series`, the columns of `order` and `take`, and `range`: the number of the row's range, ascending with (series, order)."""
    rows = df.select(*dict.fromkeys([series, *order, *take]))
    n = partitions or max(df.sparkSession.sparkContext.defaultParallelism, rows.count() // ROWS_A_RANGE + 1)
    return written(rows.repartitionByRange(n, series, *order).withColumn("range", F.spark_partition_id()), "ranges")


def with_previous(rows: DataFrame, series: str, order: list[str], take: list[str]) -> DataFrame:
    """`rows` as from `ranges`, with `first` (whether the row is its series' first) and `previous_<column>` of the row before it in its series."""
    inside = Window.partitionBy("range").orderBy(series, *order)
    mine, place = F.struct(F.col(series).alias("s"), *take), F.struct(series, *order)
    # one row a range
    tails = rows.groupBy("range").agg(F.max_by(mine, place).alias("t"))
    tails = tails.select(F.col("range").alias("r"), F.lag("t").over(Window.orderBy("range")).alias("tail"))
    x = rows.withColumns({"__lag": F.lag(mine).over(inside), "__n": F.row_number().over(inside)}).join(F.broadcast(tails), F.col("range") == F.col("r"), "left")
    x = x.withColumn("__p", F.when(F.col("__n") == 1, F.col("tail")).otherwise(F.col("__lag")))
    same = F.col("__p").isNotNull() & F.col("__p.s").eqNullSafe(F.col(series))
    out = x.withColumn("first", ~same)
    return out.select(*rows.columns, "first", *[F.when(same, F.col(f"__p.{c}")).alias(f"previous_{c}") for c in take])


def with_running_sum(rows: DataFrame, series: str, order: list[str], value: str, out: str) -> DataFrame:
    """`rows` with the sum of `value` from the beginning of the row's series to the row."""
    parts = rows.groupBy("range", series).agg(F.sum(value).alias("__s"))
    # a series has one row for each range it lies in
    before = Window.partitionBy(series).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("range").alias("__r"), F.col(series).alias("__k"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__b"))
    inside = Window.partitionBy("range", series).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = rows.withColumn("__i", F.sum(value).over(inside))
    x = x.join(parts, (F.col("range") == F.col("__r")) & F.col(series).eqNullSafe(F.col("__k")))
    return x.withColumn(out, F.col("__b") + F.col("__i")).select(*rows.columns, out)


def beside_previous(df: DataFrame, series: str, order: list[str], key: str, columns: list[str], partitions: int | None = None) -> DataFrame:
    """`key`, `previous` (its key; null for the first of a series), the columns, and `previous_<column>` of the row before it in its series.

    Keys are put in order alone; the columns travel twice, hashed by key, once to their own row and once to the row after.
    """
    pairs = with_previous(ranges(df, series, order, [key], partitions), series, order, [key]).select(F.col(key).alias("__key"), F.col(f"previous_{key}").alias("previous"))
    own = df.select(F.col(key), *columns)
    # as many partitions as rows need, not as few as their bytes allow: what follows is work on whole texts. First rows of series have no row before
    # them; their own key deals them out.
    n = max(df.sparkSession.sparkContext.defaultParallelism, pairs.count() // WIDE_ROWS + 1)
    before = df.select(F.xxhash64(key).alias("__h"), F.col(key).alias("__before"), *[F.col(c).alias(f"previous_{c}") for c in columns]).repartition(n, "__h")
    x = own.join(pairs, F.col(key) == F.col("__key")).drop("__key")
    x = x.withColumn("__at", F.when(F.col("previous").isNotNull(), F.xxhash64("previous")).otherwise(F.xxhash64(key, F.lit(1)))).repartition(n, "__at")
    return x.join(before, (F.col("__at") == F.col("__h")) & (F.col("previous") == F.col("__before")), "left").drop("__before", "__h", "__at")
