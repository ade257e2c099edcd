"""Session helpers: reading tables, shared folders, parallelism, rows delivered twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most keys that are sent to every executor when rows delivered twice are taken apart.
BROADCAST_KEYS = 50_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local one only where none is set (tests, one machine)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = getattr(shared_dir, "local", None) or tempfile.mkdtemp(prefix="palimpsest-")
        shared_dir.local = at
    return at


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: files in the shared folder, so a lost executor loses nothing. Partitions and their order are kept."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again: a cut in the lineage whose columns can be pruned.

    Nothing else uses the shuffles of the write, so their files are dropped when it ends; else they would lie on the disks until the driver
    happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    schema, before = df.schema, spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """At least one partition a core: a table in one small file would otherwise keep all but one core idle."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 > want else df.repartition(want)


def once(df: DataFrame, *key: str) -> DataFrame:
    """``df`` without rows delivered twice: one row for each key. Nulls count as equal.

    The keys are counted first, without the other columns. Where none repeats, wide columns are never shuffled; where few do, only
    their rows are; else all rows are.
    """
    twice = df.groupBy(*key).count().where("count > 1").select(*key)
    n = twice.limit(BROADCAST_KEYS + 1).count()
    if not n:
        return df
    if n > BROADCAST_KEYS:
        return df.dropDuplicates(list(key))
    names = {k: f"__k{i}" for i, k in enumerate(key)}
    few = df.sparkSession.createDataFrame(twice.collect(), twice.schema).select([F.col(k).alias(v) for k, v in names.items()])
    same = None
    for k, v in names.items():
        c = df[k].eqNullSafe(few[v])
        same = c if same is None else same & c
    alone = df.join(F.broadcast(few), same, "left_anti")
    return alone.unionByName(df.join(F.broadcast(few), same, "left_semi").dropDuplicates(list(key)))
