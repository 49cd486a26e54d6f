"""Live plans give what the batch plans give on the same rows."""

import datetime as dt

from pyspark.sql import functions as F

from meterline.operators import pairing
from meterline.sources import readers
from meterline.streaming import live


def events(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [("s", base + dt.timedelta(seconds=7 * i), "in", "ipv4", "udp", "1.1.1.1", "2.2.2.2", 1, 2, i, False, i) for i in range(200)]
    from meterline.schemas import SCHEMAS

    spark.createDataFrame(rows, SCHEMAS["packets"]).coalesce(1).write.parquet(str(tmp_path / "in"))
    return readers.read_packets(spark, str(tmp_path / "in")), readers.read_stream(spark, "packets", str(tmp_path / "in"))


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_tumbling(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    agg = [F.count("*").alias("n"), F.sum("bytes").alias("b")]
    want = {tuple(r) for r in live.tumbling(batch, ["dir"], agg).collect()}
    got = {tuple(r) for r in run(spark, live.tumbling(stream, ["dir"], agg), "tumbling", "complete").collect()}
    assert got == want


def test_rollup_writer(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    q = live.write_rollups(live.tumbling(stream, ["dir"], [F.count("*").alias("n")]), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    closed = spark.read.parquet(str(tmp_path / "out"))
    assert 0 < closed.count() <= live.tumbling(batch, ["dir"], [F.count("*").alias("n")]).count()


def test_pairing_and_activity(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    shape = lambda d: d.withColumn("is_response", F.col("seq") % 3 == 1).withColumn("k", F.col("seq") % 2 == 5)
    want = sorted(r.status for r in pairing.pair_transactions(shape(batch), ["k"], "is_response", ttl_ms=60_000).where("is_response").collect())
    got = run(spark, live.pair_stream(shape(stream), ["k"], "is_response", ttl_ms=60_000), "pairs")
    assert sorted(r.status for r in got.where("status != 'purged'").collect()) == want
    starts = run(spark, live.activity_stream(stream, "stream"), "starts")
    last, n = None, 0
    for i in range(200):
        if last is None or 7 * i >= last + 60:
            last, n = 7 * i, n + 1
    assert starts.count() == n
