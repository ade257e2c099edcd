"""Streams against their batch twins over the same events."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.operators import editions as E
from palimpsest.operators import relational as R
from palimpsest.operators import state as S
from palimpsest.session import table
from palimpsest.streaming import twins


@pytest.fixture(scope="module")
def feed(spark, sf, tmp_path_factory):
    """Events in four files, in order of time."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path_factory.mktemp("feed"))
    for i in range(4):
        e.where(F.pmod(F.floor(F.dayofmonth("ts") / 8), F.lit(4)) == i).coalesce(1).write.mode("append").parquet(path)
    return e, lambda: spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return stream.sparkSession.table(name)


def test_rate_limit(spark, feed):
    e, stream = feed
    got = run(twins.rate_limit(stream(), "user_id", "ts", "1 hour", 2, "100 days"), "rate", "complete")
    want = e.groupBy("user_id", F.date_trunc("hour", "ts").alias("start")).agg(F.count("*").alias("writes"))
    assert sorted((r.user_id, r.start, r.writes) for r in got.collect()) == sorted((r.user_id, r.start, r.writes) for r in want.collect())


def test_latest(spark, feed, tmp_path):
    e, stream = feed
    q = twins.latest_into(stream(), "user_id", "ts", F.col("event_type"), str(tmp_path / "state"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    last = max((tmp_path / "state").iterdir(), key=lambda p: int(p.name))
    got = {r.user_id: (r.at, r.value) for r in spark.read.parquet(str(last)).collect()}
    want = {r.user_id: (r.at, r.value) for r in S.latest(e, "user_id", "ts", "event_type").collect()}
    assert got == want


def test_versions_and_runs(spark, feed):
    e, stream = feed
    got = run(twins.versions(stream().select("user_id", "ts", "event_type"), "user_id", "ts", "event_type"), "versions")
    # files come in order of days, so the stream sees a user's events in order
    want = E.change_points(e.select("user_id", "ts", "event_type"), "user_id", ["ts"], ["event_type"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    bad = e.withColumn("bad", F.col("event_type") == "error")
    got = run(twins.failure_runs(stream().withColumn("bad", F.col("event_type") == "error").select("user_id", "ts", "bad"), "user_id", "ts", "bad", 2), "failures")
    r = R.islands(bad, ["user_id"], ["ts"], F.col("bad")).where("bad")
    w = Window.partitionBy("user_id", "run").orderBy("ts")
    want = r.withColumn("i", F.row_number().over(w)).where("i = 2").select("user_id", "ts")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_revisions(spark, tmp_path):
    rows = [(1, 1, 0), (1, 2, 0), (1, 3, 1), (1, 4, 5), (2, 5, 1), (2, 6, 0), (1, 7, 2)]
    df = spark.createDataFrame(rows, "k long, o long, expected long")
    df.coalesce(1).write.parquet(str(tmp_path / "w"))
    got = run(twins.revisions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "w")), "k", "o", "expected"), "revisions")
    landed = {(r.k, r.o): r.landed for r in got.collect()}
    assert landed == {(1, 1): True, (1, 2): False, (1, 3): True, (1, 4): False, (2, 5): False, (2, 6): True, (1, 7): True}
    batch = {r.k: (r.revision, r.landed, r.writes) for r in S.revisions(df, "k", ["o"], "expected").collect()}
    assert batch == {1: (3, 3, 5), 2: (1, 1, 2)}
