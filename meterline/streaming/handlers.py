"""Handlers on live streams: each micro-batch adds mergeable states, which read as the batch handler's long form."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.metrics import STATE_KEYS, add_states, read_states
from ..plans import handlers as h
from .batches import Left, Step, Tables, _fs, close, numbers, pair_step, run_batches

#: Handlers that look at one event at a time; their states don't depend on the order or the split of events.
STATELESS: dict[str, Callable] = {"net": h.net, "net_v1": h.net_v1, "flow": h.flow, "bgp": h.bgp}


def states_step(handler: str, o: h.Options | None = None, d: h.Dimensions | None = None, *, ttl_ms: int = 5000, delay_s: int = 120) -> Step:
    """The states of one micro-batch. Late events, however late, add to their own period.

    For ``dns``, requests and responses are paired in event time behind a watermark (see :func:`pair_step`), so events
    later than ``delay_s`` are only counted in ``num_events``; ``top_slow_xacts``, whose mark depends on the whole period
    before, is left to the batch handler.
    """
    o, d = replace(o or h.Options(), mode="states"), d or h.Dimensions()
    if handler in STATELESS:
        args = () if handler == "bgp" else (d,)
        return lambda rows, left, final: ({} if final else {"states": STATELESS[handler](rows, o, *args)}, {})
    if handler != "dns":
        raise ValueError(f"no live plan of {handler}")
    pairing = pair_step(h._SLOT, "is_response", ttl_ms=ttl_ms, delay_s=delay_s, pair=lambda rows: h.dns_paired(rows, o, ttl_ms))

    def step(rows: DataFrame, left: Left, final: bool) -> tuple[Tables, Tables]:
        finished, kept = pairing(h.dns_rows(rows, o, d), left, final)
        states = h.dns_metrics(h.dns_finished(h._late(finished["paired"]), o), o)
        if o.event_counts:
            states = states.unionByName(h.event_metrics(h._prepared(rows, o), o, "dns", "dns"))
        return {"states": states}, kept

    return step


def live_handler(stream: DataFrame, handler: str, folder: str, o: h.Options | None = None, d: h.Dimensions | None = None, *, once: bool = True, **more) -> StreamingQuery:
    """Starts a handler on a stream of events; ``folder`` (shared) gets its progress, state and results."""
    return run_batches(stream, states_step(handler, o, d, **more), folder, once=once)


def close_handler(spark: SparkSession, handler: str, folder: str, schema, o: h.Options | None = None, d: h.Dimensions | None = None, **more) -> None:
    """After the end of a finite stream: what waits for the watermark is taken too."""
    close(spark, folder, states_step(handler, o, d, **more), schema)


def live_states(spark: SparkSession, folder: str) -> DataFrame:
    """All states so far: the newest compacted table, and what batches after it added."""
    base = max(numbers(spark, f"{folder}/base"), default=None)
    new = spark.read.parquet(f"{folder}/out/states")
    columns = [c for c in new.columns if c != "batch"]
    if base is None:
        return new.select(columns)
    return new.where(F.col("batch") > base).select(columns).unionByName(spark.read.parquet(f"{folder}/base/{base}").select(columns))


def live_metrics(spark: SparkSession, folder: str, o: h.Options | None = None) -> DataFrame:
    """The long form of all that has been taken so far; may be read at any time, while the stream runs."""
    o = o or h.Options()
    return read_states(live_states(spark, folder), o.topn_count, o.topn_percentile_threshold)


def compact(spark: SparkSession, folder: str) -> None:
    """Adds up the states of all batches so far into one table, and drops the batches. Run by one process at a time.

    The table is complete before it counts (its folder gets its name last), and batches go only then.
    """
    done = numbers(spark, f"{folder}/out/states")
    if not done:
        return
    last, draft = done[-1], f"{folder}/drafts/{done[-1]}"
    fs, path = _fs(spark, f"{folder}/base/{last}")
    if not fs.exists(path):
        add_states(live_states(spark, folder), STATE_KEYS).write.mode("overwrite").parquet(draft)
        fs.mkdirs(_fs(spark, f"{folder}/base")[1])
        fs.rename(_fs(spark, draft)[1], path)
    for n in done[:-1]:  # the newest stays, so that the folder never is empty
        fs.delete(_fs(spark, f"{folder}/out/states/batch={n}")[1], True)
