"""Periods: how rows get one, and which periods a report reads."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .running import running_max
from .selection import percentiles_of, same_keys

SECONDS = 60


class PeriodError(ValueError):
    """A period that can't be reported."""


def assign_periods(df: DataFrame, ts: str = "ts", *, origin: str = "epoch", stream: str | None = None, seq: str | None = None, seconds: int = SECONDS) -> DataFrame:
    """``df`` with ``period_start`` and ``period_len``.

    Origin ``epoch``: tumbling periods on the clock. ``stream_start``: tumbling from the first second of the stream.
    ``activity``: a period opens at the first event, in arrival order, whose second is ``seconds`` or more after the
    last start; gaps open nothing and late events stay in the open period.
    """
    if origin == "epoch":
        return df.withColumn("period_start", F.window(ts, f"{seconds} seconds")["start"]).withColumn("period_len", F.lit(seconds).cast("bigint"))
    at = F.unix_seconds(F.col(ts).cast("timestamp"))
    keys = [stream] if stream else []
    if origin == "stream_start":
        first = F.min(at).over(Window.partitionBy(*(keys or [F.lit(0)]))) if stream else None
        if first is None:
            base = df.agg(F.min(at).alias("_first"))
            out = df.crossJoin(F.broadcast(base))  # one row
        else:
            out = df.withColumn("_first", first)
        start = F.col("_first") + F.floor((at - F.col("_first")) / seconds) * seconds
        return out.withColumn("period_start", F.timestamp_seconds(start)).withColumn("period_len", F.lit(seconds).cast("bigint")).drop("_first")
    if origin != "activity":
        raise ValueError(f"unknown origin: {origin}")
    seen = running_max(df.withColumn("_sec", at), "_sec", keys, seq or ts, out="_high").drop("_sec")
    starts = activity_starts(seen, keys, "_high", seconds)
    found = nearest_start(seen, "_high", starts, stream, after=False)
    out = found.withColumn("period_start", F.timestamp_seconds("start")).withColumn("period_len", F.lit(seconds).cast("bigint"))
    return out.drop("_high", "start")


def activity_starts(df: DataFrame, keys: Sequence[str], second: str, seconds: int = SECONDS, day: int = 86_400) -> DataFrame:
    """The starts of activity periods, from the distinct seconds of each stream. Columns: ``_<key>``, start.

    A start depends on the one before, so each day of a stream first says, for each second at which it can be entered,
    where it would be left; these few steps are followed through the days, and then each day lists its own starts.
    """
    names = [f"_{k}" for k in keys]
    own = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(second).cast("bigint").alias("s")).where("s is not null").distinct().withColumn("_day", F.floor(F.col("s") / day).cast("bigint"))
    fields = "".join(f"{n} {own.schema[n].dataType.simpleString()}, " for n in names)

    def following(x: np.ndarray) -> np.ndarray:
        return np.searchsorted(x, x + seconds)

    def steps(part: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(part["s"].to_numpy())
        after, left = following(x), x + seconds
        for i in range(len(x) - 1, -1, -1):
            if after[i] < len(x):
                left[i] = left[after[i]]
        at = x[: np.searchsorted(x, x[0] // day * day + seconds) + 1]  # entered at one of these
        return pd.DataFrame({**{n: part[n].iloc[0] for n in names}, "_day": x[0] // day, "enter": at, "leave": left[: len(at)]})

    def follow(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_day", "enter"])
        days, enter, leave = (part[c].to_numpy() for c in ("_day", "enter", "leave"))
        edges = np.flatnonzero(np.diff(days, prepend=days[0] - 1))
        now, out = enter[0], []
        for a, b in zip(edges, [*edges[1:], len(days)]):
            i = a + np.searchsorted(enter[a:b], now)
            if i < b:
                out.append((days[i], enter[i]))
                now = leave[i]
        return pd.DataFrame({**{n: part[n].iloc[0] for n in names}, "_day": [d for d, _ in out], "enter": [e for _, e in out]})

    def listed(part: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(part["s"].to_numpy())
        after, i, out = following(x), int(np.searchsorted(x, part["enter"].iloc[0])), []
        while i < len(x):
            out.append(x[i])
            i = int(after[i])
        return pd.DataFrame({**{n: part[n].iloc[0] for n in names}, "start": out})

    by_day = [*names, "_day"]
    entered = own.groupBy(*by_day).applyInPandas(steps, fields + "_day bigint, enter bigint, leave bigint").groupBy(*(names or [F.lit(0)])).applyInPandas(follow, fields + "_day bigint, enter bigint")
    entered = entered.withColumnsRenamed({n: n + "_" for n in by_day})
    same = F.lit(True)
    for n in by_day:
        same = same & F.col(n).eqNullSafe(F.col(n + "_"))
    return own.join(entered, same).groupBy(*by_day).applyInPandas(listed, fields + "start bigint")


def nearest_start(df: DataFrame, second: str, starts: DataFrame, stream: str | None = None, *, after: bool, hour: int = 3600, asked: DataFrame | None = None) -> DataFrame:
    """``df`` with the columns of the first row of ``starts`` at or ``after`` ``second`` (else the last one at or before it), null where there is none.

    ``starts(start, ...)`` has a row for each period, by ``_<stream>`` if given. Rows meet the starts of their hour, and
    the nearest start of other hours; only hours are sorted, not rows. ``asked``, if at hand, has a row (``second``, by
    ``_<stream>``) in each hour that rows have; the small table of hours is written then, and its size is known to the join.
    """
    keys = [f"_{stream}"] if stream else []
    more = [c for c in starts.columns if c not in keys and c != "start"]
    in_hour = lambda c: F.floor(F.col(c) / hour).cast("bigint")
    own = starts.select(*keys, in_hour("start").alias("_hour"), F.struct("start", *more).alias("_row"))
    known = asked is not None
    asked = asked if known else df.select(*([F.col(stream).alias(f"_{stream}")] if stream else []), second)
    asked = asked.select(*keys, in_hour(second).alias("_hour")).where("_hour is not null").distinct()
    hours = asked.withColumn("_row", F.lit(None).cast(own.schema["_row"].dataType)).unionByName(own).groupBy(*keys, "_hour").agg(F.array_sort(F.collect_list("_row")).alias("_in"))
    by = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_hour")
    if after:
        hours = hours.withColumn("_other", F.first(F.try_element_at("_in", F.lit(1)), ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing)))
    else:
        hours = hours.withColumn("_other", F.last(F.try_element_at("_in", F.lit(-1)), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    hours = hours.withColumnsRenamed({"_hour": "_at", **({f"_{stream}": "_of"} if stream else {})})
    hours = written(hours, "hours") if known else hours
    same = in_hour(second) == F.col("_at")
    out = df.join(hours, same & F.col(stream).eqNullSafe(F.col("_of")) if stream else same, "left")
    fits = F.filter("_in", lambda s: s["start"] >= F.col(second) if after else s["start"] <= F.col(second))
    out = out.withColumn("_found", F.coalesce(F.try_element_at(fits, F.lit(1 if after else -1)), F.col("_other"))).drop("_in", "_other", "_at", "_of")
    return out.withColumns({c: F.col("_found")[c] for c in ["start", *more]}).drop("_found")


def heartbeat(df: DataFrame, ts: str = "ts", *, stream: str, every: int = 30) -> DataFrame:
    """Clock ticks of each stream from its first to its last event: ``stream, ts, is_tick``."""
    span = df.groupBy(stream).agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    return span.select(stream, F.explode(F.sequence("a", "b", F.expr(f"interval {every} seconds"))).alias(ts), F.lit(True).alias("is_tick"))


def seconds_of(df: DataFrame, stream: str, ts: str = "ts") -> DataFrame:
    """``k, s, n``: the number of events of each stream and second that has some."""
    return df.where(F.col(ts).isNotNull()).groupBy(F.col(stream).alias("k"), F.unix_seconds(F.col(ts).cast("timestamp")).alias("s")).agg(F.count("*").alias("n"))


def with_ticks(taken: DataFrame, known: DataFrame, last: Column, every: int) -> DataFrame:
    """``taken`` (``k, s, n``) with a second of no events at each tick of each stream: every so many seconds from its
    ``first``, those after ``until`` (both in ``known``, by ``k``) up to ``last``."""
    begin = F.col("first") + F.ceil((F.col("until") + 1 - F.col("first")) / every) * every
    ticks = known.where(begin <= last).select("k", F.explode(F.sequence(begin, last, F.lit(every).cast("bigint"))).alias("s"), F.lit(0).cast("bigint").alias("n"))
    return taken.unionByName(ticks).groupBy("k", "s").agg(F.sum("n").alias("n"))


def activity_counts(taken: DataFrame, seconds: int = SECONDS) -> DataFrame:
    """``k, start, next, n``: the activity periods of seconds with events or ticks, in event time, and their events."""
    starts = activity_starts(taken, ["k"], "s", seconds).select("_k", "start")
    n = nearest_start(taken, "s", starts, "k", after=False).groupBy("k", "start").agg(F.sum("n").alias("n"))
    return n.withColumn("next", F.lead("start").over(Window.partitionBy("k").orderBy("start")))


def clock_periods(df: DataFrame, stream: str, ts: str = "ts", *, every: int = 30, seconds: int = SECONDS) -> DataFrame:
    """``stream, period_start, num_events`` of activity periods that the clock closes too.

    A clock ticks every so many seconds from each stream's first event to the newest event of all, and a tick opens a
    period as an event does; so a stream that falls silent gets its empty periods.
    """
    taken = seconds_of(df, stream, ts)
    known = taken.groupBy("k").agg(F.min("s").alias("first")).withColumn("until", F.col("first") - 1)
    newest = taken.agg(F.max("s").alias("last"))
    out = activity_counts(with_ticks(taken, known.crossJoin(F.broadcast(newest)), F.col("last"), every), seconds)  # one row
    return out.select(F.col("k").alias(stream), F.timestamp_seconds("start").alias("period_start"), F.col("n").alias("num_events"))


def period_rank(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``period``: 0 for the newest period of its keys, 1 for the one before, and so on.

    Ranks come from the small table of distinct periods, so the rows themselves are not sorted.
    """
    known = df.select(*keys, "period_start").distinct()
    ranked = known.withColumn("period", F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("period_start"))) - 1)
    return df.join(ranked, [*keys, "period_start"])


def clamp_periods(n: int | None) -> int:
    return 5 if n is None else min(10, max(1, n))


def retain(df: DataFrame, n: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of the newest ``n`` periods (5 if not given, 1 to 10)."""
    return period_rank(df, keys).where(F.col("period") < clamp_periods(n)).drop("period")


def bucket(df: DataFrame, period: int, n: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of one period by recency. Errors: at or beyond ``n``, and a period that no key has yet."""
    if not 0 <= period < clamp_periods(n):
        raise PeriodError("invalid metrics period")
    found = period_rank(df, keys).where(F.col("period") == period).drop("period")
    if found.isEmpty():
        raise PeriodError("this metrics period is not yet accumulated")
    return found


def merged_periods(df: DataFrame, period: int, n: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """The newest ``period`` periods, at most ten of each key: ``period_start``, and of them as one ``_from`` and ``_len``."""
    if not 2 <= period <= clamp_periods(n):
        raise PeriodError("invalid metrics period")
    known = df.select(*keys, "period_start", "period_len").distinct()
    by = Window.partitionBy(*(keys or [F.lit(0)]))
    known = known.withColumn("_r", F.row_number().over(by.orderBy(F.desc("period_start")))).where(F.col("_r") <= period)
    return known.withColumn("_from", F.min("period_start").over(by)).withColumn("_len", F.sum("period_len").over(by)).select(*keys, "period_start", "_from", "_len")


def as_one(df: DataFrame, known: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of the ``known`` periods (see :func:`merged_periods`), all in one period."""
    return df.drop("period_len").join(known, [*keys, "period_start"]).drop("period_start").withColumnsRenamed({"_from": "period_start", "_len": "period_len"})


def merged_window(df: DataFrame, period: int, n: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """The newest ``period`` periods as one: ``period_start`` is the first start, ``period_len`` the sum of lengths."""
    return as_one(df, merged_periods(df, period, n, keys), keys)


def period_bounds(df: DataFrame, ts: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """``period_start, period_end, length`` (whole seconds): the end is the next start, or the last event."""
    spans = df.groupBy(*keys, "period_start").agg(F.max(ts).alias("last"), F.count("*").alias("num_events"))
    nxt = F.lead("period_start").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("period_start"))
    out = spans.withColumn("period_end", F.coalesce(nxt, F.col("last").cast("timestamp")))
    return out.select(*keys, "period_start", "period_end", (F.unix_seconds("period_end") - F.unix_seconds("period_start")).alias("length"), "num_events")


def period_info(df: DataFrame, ts: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """What a report lists of each period: bounds as text, whether it is closed, length, events."""
    b = period_bounds(df, ts, keys)
    newest = F.max("period_start").over(Window.partitionBy(*(keys or [F.lit(0)])))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return b.select(*keys, text("period_start").alias("start"), text("period_end").alias("end"), (F.col("period_start") != newest).alias("read_only"), "length", "num_events")


def prior_period_p90(df: DataFrame, value: str, keys: Sequence[str], mode: str = "exact") -> DataFrame:
    """``keys, period_start, slow_mark``: the p90 of the value in the newest earlier period that has one; 0 if none.

    Mode ``exact`` selects it by ranges (see ``selection``); ``sketch`` from a sketch of bounded size.
    """
    by = [*keys, "period_start"]
    if mode == "exact":
        marks = percentiles_of(df, by, value, [0.9]).select(*[F.col(k).alias(f"_{k}") for k in by], F.get("marks", F.lit(0)).alias("p90"))
        known = df.select(*by).distinct()
        p90 = known.join(marks, same_keys(by, right="_"), "left").select(*by, "p90")
    else:
        p90 = df.groupBy(*by).agg(F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(F.col(value).cast("double")), F.lit(0.9)).alias("p90"))
    before = Window.partitionBy(*keys).orderBy("period_start").rowsBetween(Window.unboundedPreceding, -1)
    return p90.select(*by, F.coalesce(F.last("p90", ignorenulls=True).over(before), F.lit(0)).alias("slow_mark"))


def slow_rows(df: DataFrame, value: str, keys: Sequence[str], mode: str = "exact") -> DataFrame:
    """``df`` with ``is_slow``: the value reaches the p90 of the period before."""
    marks = written(prior_period_p90(df, value, keys, mode), "marks")  # a row a period, a size that the join knows
    return df.join(marks, [*keys, "period_start"]).withColumn("is_slow", (F.col("slow_mark") > 0) & (F.col(value) >= F.col("slow_mark")))


def scrape_period(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of the newest closed period, or of the open one where there is no other."""
    ranked = period_rank(df, keys)
    most = F.least(F.max("period").over(Window.partitionBy(*(keys or [F.lit(0)]))), F.lit(1))
    known = ranked.select(*keys, "period_start", "period").distinct().withColumn("_pick", most).where(F.col("period") == F.col("_pick")).select(*keys, "period_start")
    return df.join(known, [*keys, "period_start"])
