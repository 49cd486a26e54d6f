"""Requests paired with responses: one slot for each key, by windows over each key's rows in time order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .periods import nearest_start


def pair_transactions(df: DataFrame, keys: Sequence[str], is_response: str, ts: str = "ts", seq: str = "seq", *, ttl_ms: int = 5000, carry: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``status``, ``elapsed_us`` and, on responses, ``query_<column>`` of the query for each of ``carry``.

    A query takes its key's slot, even an occupied one; a response takes and clears it. Responses are ``valid``,
    ``timed_out`` (``ttl_ms`` or more after the query) or ``orphan`` (empty slot); queries are ``answered``, ``replaced``
    by a later query, or ``open``. Order: time, then ``seq``.
    """
    w = Window.partitionBy(*keys).orderBy(ts, seq)
    out = df.withColumns({"_was": F.lag(is_response).over(w), "_then": F.lag(ts).over(w), "_next": F.lead(is_response).over(w), **{f"query_{c}": F.lag(c).over(w) for c in carry}})
    matched = F.col(is_response) & (F.col("_was") == F.lit(False))
    elapsed = F.when(matched, F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_then").cast("timestamp")))
    status = F.when(F.col(is_response), F.when(~F.coalesce(matched, F.lit(False)), "orphan").when(elapsed >= ttl_ms * 1000, "timed_out").otherwise("valid")).otherwise(F.when(F.col("_next").isNull(), "open").when(F.col("_next"), "answered").otherwise("replaced"))
    out = out.withColumns({"elapsed_us": elapsed, "status": status, **{f"query_{c}": F.when(matched, F.col(f"query_{c}")) for c in carry}})
    return out.drop("_was", "_then", "_next")


def due_starts(df: DataFrame, starts: DataFrame, is_response: str, ts: str = "ts", *, ttl_ms: int = 5000, stream: str | None = None, asked: DataFrame | None = None) -> DataFrame:
    """``df`` with what :func:`purge_timeouts` needs of ``starts``: the first start at which a query is overdue.

    It depends on the row alone, so it may be joined before pairing: all windows are of one sort and pass then. ``asked``
    holds a row of each hour in which queries fall due (``_due``, by ``_<stream>``), if it is at hand.
    """
    sec = F.unix_seconds(F.col(ts).cast("timestamp"))
    rows = df.withColumns({"_sec": sec, "_due": F.when(~F.col(is_response), sec + ttl_ms // 1000)})
    return nearest_start(rows, "_due", starts, stream, after=True, asked=asked).drop("_due")


def purge_timeouts(paired: DataFrame, starts: DataFrame | None, keys: Sequence[str], is_response: str, ts: str = "ts", seq: str = "seq", *, ttl_ms: int = 5000, stream: str | None = None) -> DataFrame:
    """Reclassifies what a period shift removes: ``paired`` with ``status`` and, on purged queries, ``purged_at``.

    At each period start (``starts(start)``, in seconds, by ``_<stream>`` if given) open queries begun ``ttl_ms``
    (whole seconds of it) or more before it are removed: they are ``purged``, counted in the new period, and a later
    response is an ``orphan``. Other columns of ``starts`` come along on purged queries. Without ``starts``, ``paired``
    has had :func:`due_starts` before it was paired.
    """
    w = Window.partitionBy(*keys).orderBy(ts, seq)
    rows = paired if starts is None else due_starts(paired, starts, is_response, ts, ttl_ms=ttl_ms, stream=stream)
    # the slot's next event, of either side, ends an open query; responses have no start
    rows = rows.withColumns({"_end": F.lead("_sec").over(w), "_left": F.lag("start").over(w)})
    gone = F.col("start").isNotNull() & (F.col("_end").isNull() | (F.col("_end") >= F.col("start")))
    rows = rows.withColumns({"_gone": gone, "_before": F.col("_left").isNotNull() & F.coalesce(F.col("_sec") >= F.col("_left"), F.lit(True))})
    status = F.when(F.col("_gone"), "purged").when(F.col(is_response) & F.col("_before"), "orphan").otherwise(F.col("status"))
    out = rows.withColumn("status", status).withColumn("elapsed_us", F.when(F.col("status") != "orphan", F.col("elapsed_us"))).withColumn("purged_at", F.when(F.col("_gone"), F.timestamp_seconds("start")))
    return out.drop("_sec", "_end", "_left", "start", "_gone", "_before")


def propagate_query_filter(df: DataFrame, keep: Column, keys: Sequence[str], is_response: str, ts: str = "ts", seq: str = "seq", *, ttl_ms: int = 5000, carry: Sequence[str] = ()) -> DataFrame:
    """Pairs rows with their filter decision: ``counted`` marks transactions, ``filtered`` how many packets they filter.

    A filtered query still opens the slot, and its response counts as filtered; a filtered response to a kept query
    counts both its packets as filtered.
    """
    flagged = df.withColumn("keep", F.coalesce(keep, F.lit(False)))
    out = pair_transactions(flagged, keys, is_response, ts, seq, ttl_ms=ttl_ms, carry=[*carry, "keep"])
    paired = F.col(is_response) & F.col("status").isin("valid", "timed_out")
    both = F.coalesce(F.col("query_keep"), F.lit(True)) & F.col("keep")
    number = F.when(~F.col(is_response), F.when(F.col("keep"), 0).otherwise(1)).when(paired & F.col("query_keep") & ~F.col("keep"), 2).when(both, 0).otherwise(1)
    return out.withColumn("counted", F.col(is_response) & (F.col("status") == "valid") & both).withColumn("filtered", number)


def match_leases(dhcp: DataFrame, ttl_ms: int = 5000) -> DataFrame:
    """DHCP REQUEST with its ACK by transaction id: one row a valid lease, ``hostname`` Unknown where not given."""
    rows = dhcp.where((F.col("version") == 4) & F.col("msg_type").isin("REQUEST", "ACK")).withColumn("is_response", F.col("msg_type") == "ACK")
    paired = pair_transactions(rows, ["stream", "xid"], "is_response", ttl_ms=ttl_ms, carry=["hostname", "client_mac"])
    valid = paired.where("is_response and status = 'valid'")
    return valid.withColumn("client", F.concat_ws("/", F.coalesce("query_client_mac", "client_mac"), F.coalesce("query_hostname", F.lit("Unknown")), "your_ip"))


def match_probes(probes: DataFrame, ttl_ms: int = 2000) -> DataFrame:
    """Probe sends with receptions inside one period: key is the probe id for icmp, the target for tcp."""
    rows = probes.where(F.col("event").isin("send", "recv")).withColumn("is_response", F.col("event") == "recv").withColumn("probe_key", F.when(F.col("kind") == "icmp", F.col("probe_id").cast("string")).otherwise(F.col("target")))
    return pair_transactions(rows, ["stream", "period_start", "target", "probe_key"], "is_response", ttl_ms=ttl_ms)
