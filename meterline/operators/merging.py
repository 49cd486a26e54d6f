"""Merging: rollups of mergeable states, like handlers of one policy, and unions of sources."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import histogram_bound
from .selection import same_keys


#: Items that a state of tops holds at most, and items that a sketch of tops tracks.
ITEMS, TRACKED = 1024, 10_000


def _entry_states(entries: DataFrame, keys: Sequence[str], tops: Sequence[str], others: Sequence[str], size: int) -> DataFrame:
    """Per key, a column of each name: ``items`` and ``error``, from rows ``keys, name, item, weight, error`` that add up.

    ``tops`` keep their ``size`` heaviest items; what falls out is bounded by the heaviest of it, which is added to the
    error. ``others`` (histogram bounds, seconds) keep all.
    """
    sums = entries.groupBy(*keys, "name", "item").agg(F.sum("weight").alias("weight"), F.sum("error").alias("error"))
    by = Window.partitionBy(*keys, "name")
    # the row without item carries the error; one more than ``size`` items show what falls out
    ranked = sums.where("item is not null").withColumn("r", F.row_number().over(by.orderBy(F.desc("weight"), "item"))).where((F.col("r") <= size + 1) | ~F.col("name").isin(*tops))
    errors = sums.where("item is null").select(*keys, "name", "item", "weight", "error", F.lit(0).alias("r"))
    beyond = F.col("name").isin(*tops) & (F.col("r") > size)
    rows = ranked.unionByName(errors).select(*keys, "name", F.when(beyond, F.lit(None)).otherwise(F.col("item")).alias("item"), F.when(beyond, F.lit(0)).otherwise(F.col("weight")).alias("weight"), F.when(beyond, F.col("error") + F.col("weight")).otherwise(F.col("error")).alias("error"))
    aggs = []
    for n in [*tops, *others]:
        mine = F.col("name") == n
        items = F.array_sort(F.collect_list(F.when(mine & F.col("item").isNotNull(), F.struct("item", "weight"))))
        aggs.append(F.struct(items.alias("items"), F.coalesce(F.sum(F.when(mine, F.col("error"))), F.lit(0)).alias("error")).alias(n))
    return rows.groupBy(*keys).agg(*aggs)


def _beside(left: DataFrame, right: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    if right is None:
        return left
    named = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    return left.join(named, same_keys(keys, right="_of_"), "left").drop(*[f"_of_{k}" for k in keys])


def rollup(
    df: DataFrame, keys: Sequence[str], *, counters: dict[str, Column] | None = None, distinct: dict[str, Column] | None = None, quantiles: dict[str, Column] | None = None, tops: dict[str, Column] | None = None,
    weighted_tops: dict[str, tuple[Column, Column]] | None = None, histograms: dict[str, Column] | None = None, rates: dict[str, Column | None] | None = None, ts: str = "ts", size: int = ITEMS,
) -> DataFrame:
    """Mergeable states by key, a column a metric, each of bounded size.

    ``counters`` are sums; ``distinct``, ``quantiles`` and ``tops`` (items by number of rows) are sketches. ``weighted_tops``
    (item, weight; weights of 0 or more) hold the ``size`` heaviest items and an ``error``: an item's true weight is at
    most that much above the one held, and an item that isn't held weighs at most that much. ``histograms`` hold the
    counts of at most 486 bounds, ``rates`` the total of each second (weight null: rows); both are exact.
    """
    tops = tops or {}
    source = df.withColumns({f"_top_{n}": c.cast("string") for n, c in tops.items()}) if tops else df
    aggs = [F.sum(c).alias(n) for n, c in (counters or {}).items()]
    aggs += [F.hll_sketch_agg(c).alias(n) for n, c in (distinct or {}).items()]
    aggs += [F.kll_sketch_agg_double(c.cast("double")).alias(n) for n, c in (quantiles or {}).items()]
    aggs += [F.expr(f"approx_top_k_accumulate(`_top_{n}`, {TRACKED}) FILTER (WHERE `_top_{n}` IS NOT NULL)").alias(n) for n in tops]
    out = source.groupBy(*keys).agg(*(aggs or [F.count("*").alias("_rows")]))
    entry = lambda n, item, weight: F.when(item.isNotNull(), F.struct(F.lit(n).alias("name"), item.cast("string").alias("item"), weight.cast("bigint").alias("weight"), F.lit(0).cast("bigint").alias("error")))
    second = F.unix_seconds(F.col(ts).cast("timestamp"))
    rows = [entry(n, item, F.coalesce(w, F.lit(0))) for n, (item, w) in (weighted_tops or {}).items()]
    rows += [entry(n, histogram_bound(v), F.lit(1)) for n, v in (histograms or {}).items()]
    rows += [entry(n, second if w is None else F.when(w.isNotNull(), second), F.lit(1) if w is None else w) for n, w in (rates or {}).items()]
    if rows:
        entries = df.select(*keys, F.inline(F.array_compact(F.array(*rows))))
        out = _beside(out, _entry_states(entries, keys, [*(weighted_tops or {})], [*(histograms or {}), *(rates or {})], size), keys)
    return out.drop("_rows")


def merge_rollups(
    states: DataFrame, keys: Sequence[str], *, counters: Sequence[str] = (), distinct: Sequence[str] = (), quantiles: Sequence[str] = (), tops: Sequence[str] = (), weighted_tops: Sequence[str] = (), histograms: Sequence[str] = (), rates: Sequence[str] = (), size: int = ITEMS
) -> DataFrame:
    """States of coarser keys from finer ones: counters, bounds and seconds add, sketches and tops merge."""
    aggs = [F.sum(n).alias(n) for n in counters]
    aggs += [F.hll_union_agg(n).alias(n) for n in distinct]
    aggs += [F.kll_merge_agg_double(n).alias(n) for n in quantiles]
    aggs += [F.expr(f"approx_top_k_combine(`{n}`, {TRACKED})").alias(n) for n in tops]
    out = states.groupBy(*keys).agg(*(aggs or [F.count("*").alias("_rows")]))
    names = [*weighted_tops, *histograms, *rates]
    if names:
        row = lambda n, item, weight, error: F.struct(F.lit(n).alias("name"), item.cast("string").alias("item"), weight.cast("bigint").alias("weight"), error.cast("bigint").alias("error"))
        null, none = F.lit(None), F.lit(0)
        items = lambda n: F.transform(F.col(n)["items"], lambda e: row(n, e["item"], e["weight"], none))
        each = [F.concat(items(n), F.array(row(n, null, none, F.col(n)["error"]))) for n in names]
        each = [F.coalesce(e, F.array().cast("array<struct<name:string,item:string,weight:bigint,error:bigint>>")) for e in each]
        entries = states.select(*keys, F.inline(F.concat(*each)))
        out = _beside(out, _entry_states(entries, keys, weighted_tops, [*histograms, *rates], size), keys)
    return out.drop("_rows")


def heaviest(state: str, n: int = 10) -> Column:
    """The ``n`` heaviest items of a state of weighted tops, ties by item, as an array of (item, weight)."""
    heavier = lambda a, b: F.when(a["weight"] > b["weight"], -1).when(a["weight"] < b["weight"], 1).when(a["item"] < b["item"], -1).when(a["item"] > b["item"], 1).otherwise(0)
    return F.slice(F.array_sort(F.col(state)["items"], heavier), 1, n)


def histogram_quantiles(state: str, marks: Sequence[float]) -> Column:
    """Of a histogram state, the bound of the bucket that holds each mark, as an array."""
    pairs = F.array_sort(F.transform(F.col(state)["items"], lambda e: F.struct(e["item"].cast("double").alias("bound"), e["weight"].alias("weight"))))
    total = F.aggregate(pairs, F.lit(0).cast("bigint"), lambda a, e: a + e["weight"])
    start = F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(None).cast("double").alias("bound"))

    def at(p: float) -> Column:
        wanted = F.greatest(F.ceil(total * p), F.lit(1))
        step = lambda a, e: F.when(a["upto"] >= wanted, a).otherwise(F.struct((a["upto"] + e["weight"]).alias("upto"), e["bound"].alias("bound")))
        return F.aggregate(pairs, start, step)["bound"]

    return F.array(*[at(p) for p in marks])


def rate_quantiles(state: str, seconds: Column, marks: Sequence[float]) -> Column:
    """Of a rate state, inclusive quantiles of the totals of all ``seconds`` of its time, as an array; seconds without rows are 0."""
    totals = F.array_sort(F.col(state)["items"]["weight"])
    n = F.greatest(seconds, F.size(totals))
    place = lambda p: F.greatest(F.ceil(n * p), F.lit(1)) - (n - F.size(totals))
    return F.array(*[F.when(place(p) < 1, F.lit(0).cast("bigint")).otherwise(F.get(totals, (place(p) - 1).cast("int"))) for p in marks])


def latest_second(state: str, clock: Column) -> Column:
    """Of a rate state, the total of the last second that was complete when the newest event had second ``clock``."""
    found = F.filter(F.col(state)["items"], lambda e: e["item"].cast("bigint") == clock - 1)
    return F.coalesce(F.get(found, F.lit(0))["weight"], F.lit(0).cast("bigint"))


def read_rollups(states: DataFrame, keys: Sequence[str], *, counters: Sequence[str] = (), distinct: Sequence[str] = (), quantiles: Sequence[str] = (), tops: Sequence[str] = (), weighted_tops: Sequence[str] = (), n: int = 10) -> DataFrame:
    """Numbers and arrays of states. Weighted tops come with their error, as ``<name>_error``."""
    marks = F.array(*[F.lit(x) for x in (0.5, 0.9, 0.95, 0.99)])
    columns = [F.hll_sketch_estimate(c).alias(c) for c in distinct] + [F.kll_sketch_get_quantile_double(F.col(c), marks).alias(c) for c in quantiles]
    columns += [F.expr(f"approx_top_k_estimate(`{c}`, {n})").alias(c) for c in tops]
    for c in weighted_tops:
        columns += [heaviest(c, n).alias(c), F.col(c)["error"].alias(f"{c}_error")]
    return states.select(*keys, *counters, *columns)


def merge_like_handlers(handler: Callable[..., DataFrame], taps: dict[str, DataFrame], options, *more) -> DataFrame:
    """One report of like handlers on several taps: ``handler(events, options, *more)`` over the union of their events.

    Re-aggregation makes distinct counts, tops and quantiles those of all taps together: what two taps both saw is one
    item. Streams of different taps stay apart, so no transaction pairs across taps. For rollups see :func:`merge_rollups`.
    """
    return handler(union_sources(taps).drop("tap"), options, *more)


def select_sources(sources: DataFrame, *, name: str | None = None, all_tags: dict[str, str] | None = None, any_tags: dict[str, str] | None = None) -> DataFrame:
    """Rows of ``sources(name, type, tags map)`` by name, or by tags: every pair, or any. No match is an error."""
    test = F.lit(True)
    if name is not None:
        test = F.col("name") == name
    elif all_tags:
        for k, v in all_tags.items():
            test = test & F.coalesce(F.col("tags")[k] == str(v), F.lit(False))
    elif any_tags:
        test = F.lit(False)
        for k, v in any_tags.items():
            test = test | F.coalesce(F.col("tags")[k] == str(v), F.lit(False))
    found = sources.where(test)
    if found.isEmpty():
        raise ValueError("no source matches the selector")
    return found


def union_sources(tapped: dict[str, DataFrame]) -> DataFrame:
    """One table of many sources, each row labelled with its ``tap``; a ``stream`` gets the tap's name before its own."""
    parts = [df.withColumn("tap", F.lit(tap)) for tap, df in tapped.items()]
    parts = [df.withColumn("stream", F.concat_ws("/", "tap", "stream")) if "stream" in df.columns else df for df in parts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def sequence_filter(df: DataFrame, keeps: Sequence[Column]) -> DataFrame:
    """Handlers in sequence: ``seen_by`` says how many of the handlers, in order, see a row; each sees what the one before kept."""
    seen = F.lit(len(keeps))
    for i in range(len(keeps) - 1, 0, -1):
        passed = F.lit(True)
        for k in keeps[:i]:
            passed = passed & F.coalesce(k, F.lit(False))
        seen = F.when(passed, seen).otherwise(F.lit(i)) if i == len(keeps) - 1 else F.when(~passed, F.lit(i)).otherwise(seen)
    return df.withColumn("seen_by", seen)
