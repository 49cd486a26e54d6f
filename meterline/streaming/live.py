"""The live surface: tumbling and sliding aggregation, pairing and activity periods with state, a rollup writer.

Event time drives everything. Rows later than the watermark (two minutes unless given) are dropped by Spark's
stateful operators; the batch plans put late rows into the open period instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shipping import ship

WATERMARK = "2 minutes"


def tumbling(events: DataFrame, keys: Sequence[str], aggs: Sequence[Column], *, ts: str = "ts", width: str = "60 seconds", watermark: str = WATERMARK) -> DataFrame:
    """Aggregates of tumbling periods; works on streams and on tables alike."""
    if events.isStreaming:
        events = events.withWatermark(ts, watermark)
    return events.groupBy(F.window(ts, width), *keys).agg(*aggs).withColumn("period_start", F.col("window.start")).drop("window")


def sliding(events: DataFrame, keys: Sequence[str], aggs: Sequence[Column], *, ts: str = "ts", width: str = "5 minutes", slide: str = "1 minute", watermark: str = WATERMARK) -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark(ts, watermark)
    return events.groupBy(F.window(ts, width, slide), *keys).agg(*aggs).withColumn("period_start", F.col("window.start")).drop("window")


def pair_stream(events: DataFrame, keys: Sequence[str], is_response: str, *, ts: str = "ts", seq: str = "seq", ttl_ms: int = 5000, watermark: str = WATERMARK) -> DataFrame:
    """Pairing of a live stream: ``keys, ts, status, elapsed_us`` of responses as they come, and of queries that time out.

    State is one open query a key. A timer at ``ttl_ms`` after the query, in event time, ends an unanswered one; for purges
    at period shifts, as the batch plans count them, see ``batches.pair_step``.
    """
    ship(events.sparkSession)
    columns = [*keys, ts, seq, is_response]
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    out = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "ts timestamp, status string, elapsed_us bigint"])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_us = state.get[0] if state.exists else None
        rows = []
        if state.hasTimedOut:
            rows.append((*key, pd.Timestamp(open_us, unit="us"), "purged", None))
            state.remove()
            yield pd.DataFrame(rows, columns=[*keys, "ts", "status", "elapsed_us"]).astype({"elapsed_us": "Int64"})
            return
        whole = pd.concat(list(batches)).sort_values([ts, seq], kind="stable")
        for when, response in zip(whole[ts], whole[is_response]):
            us = int(pd.Timestamp(when).value // 1000)
            if not response:
                open_us = us
                continue
            if open_us is None:
                rows.append((*key, when, "orphan", None))
            else:
                spent = us - open_us
                rows.append((*key, when, "timed_out" if spent >= ttl_ms * 1000 else "valid", spent))
                open_us = None
        if open_us is None:
            if state.exists:
                state.remove()
        else:
            state.update((open_us,))
            state.setTimeoutTimestamp(max(open_us // 1000 + ttl_ms, state.getCurrentWatermarkMs() + 1))
        if rows:
            yield pd.DataFrame(rows, columns=[*keys, "ts", "status", "elapsed_us"]).astype({"elapsed_us": "Int64"})

    return events.withWatermark(ts, watermark).select(*columns).groupBy(*keys).applyInPandasWithState(step, out, "open_us bigint", "append", GroupStateTimeout.EventTimeTimeout)


def activity_stream(events: DataFrame, stream: str, *, ts: str = "ts", seq: str = "seq", seconds: int = 60) -> DataFrame:
    """Period starts of activity-anchored periods, each when it opens: ``stream, period_start``. State: the last start.

    Rows count in the order in which their micro-batch has them; ``batches.activity_step`` puts them in event time.
    """
    ship(events.sparkSession)
    kind = events.schema[stream].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        whole = pd.concat(list(batches)).sort_values(seq, kind="stable")
        found = []
        for s in (int(pd.Timestamp(t).value // 10**9) for t in whole[ts]):
            if last is None or s >= last + seconds:
                last = s
                found.append(s)
        state.update((last,))
        if found:
            yield pd.DataFrame({stream: [key[0]] * len(found), "period_start": pd.to_datetime(found, unit="s")})

    return events.select(stream, ts, seq).groupBy(stream).applyInPandasWithState(step, f"`{stream}` {kind}, period_start timestamp", "last bigint", "append", GroupStateTimeout.NoTimeout)


def write_rollups(rollups: DataFrame, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Appends closed periods to partitioned Parquet; a batch that runs again replaces its own folder only."""

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    writer = rollups.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if once else writer).start()
