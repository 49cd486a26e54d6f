"""Streams whose state is a table: each micro-batch runs a batch plan over its rows and what earlier ones left.

A step gets the batch's rows and the tables left by the step before, and returns what is finished and what is left. Both
are written under the batch's number, so a batch that runs again after a failure replaces its own folders and nothing
else: results are exact once. State is spread like any table, and may hold any key however hot.

Rows may come out of order: a step takes rows in event time once the watermark (the newest time seen, less a delay) has
passed them, and keeps the rest. Rows older than the watermark before their batch are dropped. :func:`close` ends a
stream: everything left is taken.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.pairing import pair_transactions, purge_timeouts
from ..operators.periods import SECONDS, activity_counts, seconds_of, with_ticks
from ..storage import written

Tables = dict[str, DataFrame]
#: (rows, what the last step left, is it the end) -> (finished, left)
Step = Callable[[DataFrame, "Left", bool], tuple[Tables, Tables]]


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers that folders of ``path`` end with."""
    fs, p = _fs(spark, path)
    return sorted(int(s.getPath().getName().split("=")[-1]) for s in fs.listStatus(p)) if fs.exists(p) else []


class Left:
    """The tables that the step of one batch left."""

    def __init__(self, spark: SparkSession, folder: str, number: int):
        self.spark, self.path = spark, f"{folder}/left/{number}"

    def get(self, name: str) -> DataFrame | None:
        fs, p = _fs(self.spark, f"{self.path}/{name}/_SUCCESS")
        return self.spark.read.parquet(f"{self.path}/{name}") if fs.exists(p) else None


def advance(spark: SparkSession, folder: str, step: Step, number: int, rows: DataFrame, final: bool = False) -> None:
    """One step. What it left is written first and its results after, so results are never ahead of the state."""
    finished, left = step(rows, Left(spark, folder, number - 1), final)
    for name, df in left.items():
        df.write.mode("overwrite").parquet(f"{folder}/left/{number}/{name}")
    for name, df in finished.items():
        df.write.mode("overwrite").parquet(f"{folder}/out/{name}/batch={number}")
    old = numbers(spark, f"{folder}/left")
    for n in [n for n in old if n < number - 1]:
        fs, p = _fs(spark, f"{folder}/left/{n}")
        fs.delete(p, True)


def run_batches(stream: DataFrame, step: Step, folder: str, *, once: bool = True) -> StreamingQuery:
    """Starts the stream: to the end of what there is, or for ever."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/progress").foreachBatch(lambda rows, number: advance(rows.sparkSession, folder, step, number, rows))
    return (writer.trigger(availableNow=True) if once else writer).start()


def close(spark: SparkSession, folder: str, step: Step, schema) -> None:
    """After the end of a finite stream: one more step without rows that takes all that is left."""
    last = max(numbers(spark, f"{folder}/left"), default=-1)
    advance(spark, folder, step, last + 1, spark.createDataFrame([], schema), final=True)


def results(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/out/{name}").drop("batch")


def _union(*parts: DataFrame | None) -> DataFrame:
    known = [p for p in parts if p is not None]
    out = known[0]
    for p in known[1:]:
        out = out.unionByName(p)
    return out


def in_order(rows: DataFrame, left: Left, final: bool, ts: str, delay_s: int) -> tuple[DataFrame, Tables, int | None]:
    """Rows whose time the watermark has passed (all at the end); what waits; the watermark in microseconds.

    A row at the watermark's very microsecond still waits, as its equals may come.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    clock = left.get("clock")
    known = clock.first()["high"] if clock is not None else None
    if known is not None:
        rows = rows.where((at >= known - delay_s * 1_000_000) | F.col(ts).isNull())
    rows = _union(rows, left.get("waiting"))
    seen = rows.agg(F.max(at)).first()[0]
    high = max([x for x in (known, seen) if x is not None], default=None)
    mark = None if high is None else high - delay_s * 1_000_000
    spark = rows.sparkSession
    waits = {"clock": spark.createDataFrame([(high,)], "high bigint").coalesce(1)}
    if final:
        return rows, {**waits, "waiting": rows.limit(0)}, high
    if mark is None:
        return rows.limit(0), {**waits, "waiting": rows}, None
    return rows.where(at < mark), {**waits, "waiting": rows.where((at >= mark) | F.col(ts).isNull())}, mark


def pair_step(keys: Sequence[str], is_response: str, *, ts: str = "ts", seq: str = "seq", stream: str = "stream", ttl_ms: int = 5000, delay_s: int = 120, seconds: int = SECONDS, pair: Callable[[DataFrame], DataFrame] | None = None) -> Step:
    """Requests paired with responses, and open requests purged when a period shifts, as in the batch plans.

    Finished rows are ``paired``: those of ``pair_transactions`` and ``purge_timeouts``, with ``opened``, the start of the
    period whose shift purged a request. A shift is at the first event of a clock period of its stream. Left are open
    requests, and the newest period of each stream. A response after the purge of its request is an orphan.
    """

    def step(rows: DataFrame, left: Left, final: bool) -> tuple[Tables, Tables]:
        ready, waits, _ = in_order(rows, left, final, ts, delay_s)
        ready = written(ready, "ready")
        sec = F.unix_seconds(F.col(ts).cast("timestamp"))
        shifts = ready.groupBy(F.col(stream).alias("_stream"), F.timestamp_seconds(F.floor(sec / seconds) * seconds).alias("opened")).agg(F.min(sec).alias("start"))
        known = left.get("shifts")
        if known is not None:
            old = known.select(F.col("_stream").alias("_s"), F.col("opened").alias("_o"))
            shifts = shifts.join(old, F.col("_stream").eqNullSafe(F.col("_s")) & (F.col("opened") == F.col("_o")), "left_anti")
        shifts = written(shifts.select("_stream", "start", "opened"), "shifts")
        both = _union(ready, left.get("open"))
        found = (pair or (lambda df: pair_transactions(df, keys, is_response, ts, seq, ttl_ms=ttl_ms)))(both)
        found = written(purge_timeouts(found, shifts, keys, is_response, ts, seq, ttl_ms=ttl_ms, stream=stream), "paired")
        newest = _union(shifts, known).groupBy("_stream").agg(F.max_by(F.struct("start", "opened"), "opened").alias("x")).select("_stream", "x.*")
        done = found if final else found.where("status != 'open'")
        still = found.where("status = 'open'").select(*ready.columns)
        return {"paired": done}, {**waits, "open": still.limit(0) if final else still, "shifts": newest}

    return step


def activity_step(stream: str, *, ts: str = "ts", seconds: int = SECONDS, delay_s: int = 120, tick_s: int | None = None) -> Step:
    """The starts of activity-anchored periods, ``stream, period_start, num_events``, when the watermark has passed them.

    Rows are taken in event time. With ``tick_s`` a clock ticks every so many seconds from the stream's first event to
    the newest time taken, of any stream, and a tick opens a period as an event does, so a stream that falls silent
    gets its empty periods (``num_events`` 0). A period is finished when the next one has opened.
    """

    def step(rows: DataFrame, left: Left, final: bool) -> tuple[Tables, Tables]:
        ready, waits, mark = in_order(rows, left, final, ts, delay_s)
        taken = seconds_of(ready, stream, ts)
        open_ = left.get("open")  # k, first, until, start, n
        if open_ is not None:
            taken = taken.unionByName(open_.select("k", F.col("start").alias("s"), "n")).groupBy("k", "s").agg(F.sum("n").alias("n"))
        taken = written(taken, "taken")
        known = taken.groupBy("k").agg(F.min("s").alias("first")).withColumn("until", F.col("first") - 1)
        if open_ is not None:
            old = open_.select(F.col("k").alias("_j"), F.col("first").alias("_f"), F.col("until").alias("_u"))
            known = known.join(old, F.col("k").eqNullSafe(F.col("_j")), "left").select("k", F.coalesce("_f", "first").alias("first"), F.coalesce("_u", "until").alias("until"))
        if tick_s and mark is not None:
            last = F.lit((mark if final else mark - 1) // 1_000_000).cast("bigint")
            taken = written(with_ticks(taken, known, last, tick_s), "taken")
            known = known.withColumn("until", F.greatest("until", last))
        held = written(activity_counts(taken, seconds), "held")
        done = held if final else held.where("next is not null")
        done = done.select(F.col("k").alias(stream), F.timestamp_seconds("start").alias("period_start"), F.col("n").alias("num_events"))
        still = held.where("next is null").withColumnRenamed("k", "_j").join(known, F.col("_j").eqNullSafe(F.col("k"))).select("k", "first", "until", "start", "n")
        return {"periods": done}, {**waits, "open": still.limit(0) if final else still}

    return step
