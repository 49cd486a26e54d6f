"""Metric definitions and the plans that compute them into the long form.

A handler lists its metrics; :func:`metric_table` computes them grouped by period and dimensions. Counters alone are
plain sums. Otherwise a row gives one small row for all its counters (a mask of bits) and one for each item, value or
second that it adds to other metrics; one aggregation sums these, partly before the shuffle, so the input is read once
and makes one shuffle whatever the number and kinds of metrics. The sums are mergeable states; statistics are read off
them, and nothing unbounded is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SCHEMAS
from .running import running_sum
from .selection import percentiles_of

QUANTILES = (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))
PERIOD_SECONDS = 60
#: Items that a sketch of tops tracks at most.
TRACKED = 10_000
#: What such a sketch adds to a count at most, as a share of all counts, once it has seen more items: 3.5 by its table of 2 ** 14 places.
TRACKED_ERROR = 3.5 / 16_384


@dataclass(frozen=True)
class Metric:
    """``group`` is the metric group that must be on; None is always on. ``where`` limits the rows."""

    name: str
    group: str | None = None
    where: Column | None = None
    whole: bool = field(default=False, kw_only=True)  # over all rows of a period, without dimensions
    among: Column | None = field(default=None, kw_only=True)  # only groups with such a row report the metric

    def of(self, value: Column) -> Column:
        return value if self.where is None else F.when(self.where, value)


@dataclass(frozen=True)
class Counter(Metric):
    weight: Column | None = None


@dataclass(frozen=True)
class Cardinality(Metric):
    item: Column | None = None


@dataclass(frozen=True)
class Quantile(Metric):
    value: Column | None = None


@dataclass(frozen=True)
class Histogram(Metric):
    value: Column | None = None
    integer: bool = True


@dataclass(frozen=True)
class TopN(Metric):
    item: Column | None = None
    weight: Column | None = None


@dataclass(frozen=True)
class Rate(Metric):
    weight: Column | None = None


def histogram_bounds() -> list[float]:
    """18 bounds a decade from 1e-9 to 1e18; the exponent is a 32-bit fraction."""
    return [float(10.0 ** float(np.float32(k) / np.float32(18)) * 10.0**e) for e in range(-9, 18) for k in range(18)]


def histogram_bound(value: Column, integer: bool = True) -> Column:
    """The first bound at or above the value; whole bounds for whole values."""
    bounds = F.array(*[F.lit(b) for b in histogram_bounds()])
    n = len(histogram_bounds())
    v = value.cast("double")
    guess = F.when(v <= 1e-9, F.lit(1)).otherwise(F.greatest(F.lit(1), F.least(F.lit(n), F.floor(F.log10(F.greatest(v, F.lit(1e-300))) * 18).cast("int") + 9 * 18)))
    near = F.filter(F.slice(bounds, guess, F.lit(4)), lambda b: b >= v)
    bound = F.coalesce(F.try_element_at(near, F.lit(1)), F.lit(histogram_bounds()[-1]))
    return F.floor(bound + 1e-6).cast("double") if integer else bound


def percentiles(column: str, marks: Sequence[float] = tuple(p for _, p in QUANTILES)) -> Column:
    """Inclusive percentiles of a column as an array: the smallest value whose cumulative share reaches the mark."""
    return F.expr(f"percentile_disc(array({', '.join(map(repr, marks))})) WITHIN GROUP (ORDER BY `{column}`)")


def top_n(df: DataFrame, keys: Sequence[str], item: str, weight: str, n: int = 10, threshold: int = 0, summed: bool = False) -> DataFrame:
    """The ``n`` items of largest summed weight for each of ``keys``, ties by item; then those whose sum reaches the
    ``threshold``-th percentile of these ``n`` sums. ``summed``: every item has one row, and none is null. Columns: keys, item, estimate, rank."""
    if not 0 <= threshold <= 100:
        raise ValueError("the percentile threshold is 0 to 100")
    if summed:
        sums = df.select(*keys, item, F.col(weight).alias("estimate"))
    else:
        sums = df.where(F.col(item).isNotNull()).groupBy(*keys, item).agg(F.sum(weight).alias("estimate"))
    order = Window.partitionBy(*keys).orderBy(F.desc("estimate"), F.asc(item))
    ranked = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    if threshold:
        count = F.count("*").over(Window.partitionBy(*keys))
        # ranks run from the largest sum down, so the inclusive percentile is at this rank
        at = count - F.greatest(F.ceil(count * threshold / 100), F.lit(1)) + 1
        mark = F.max(F.when(F.col("rank") == F.col("at"), F.col("estimate"))).over(Window.partitionBy(*keys))
        ranked = ranked.withColumn("at", at).withColumn("mark", mark).where(F.col("estimate") >= F.col("mark")).drop("at", "mark")
    return ranked


def among(rows: Column, metrics: Sequence[Metric]) -> list[Metric]:
    """The metrics of those rows alone."""
    return [replace(m, where=rows if m.where is None else rows & m.where, among=rows) for m in metrics]


#: Counters of one mask at most.
MASK = 48
#: Rows that one row gives at most by compiled code; more make a method that the JVM interprets.
FEW = 9


def _shape(c: Column | None) -> str:
    return "" if c is None else repr(c)


def _masks(metrics: Sequence[Metric]) -> list[dict]:
    """Counters that add the same weight on the same rows, as bits of one mask; distinct counts need one for their zeros."""
    found: dict[tuple, dict] = {}
    for m in metrics:
        if isinstance(m, (Counter, Cardinality)):
            weight = m.weight if isinstance(m, Counter) else None
            key = m.whole, _shape(m.among), _shape(weight)
            at = found.setdefault(key, {"whole": m.whole, "among": m.among, "weight": weight, "metrics": []})
            at["metrics"].append(m)
    out = []
    for g in found.values():
        out += [{**g, "metrics": g["metrics"][i : i + MASK]} for i in range(0, len(g["metrics"]), MASK)]
    return out


def _families(metrics: Sequence[Metric], anywhere: bool = False) -> list[dict]:
    """Metrics of the same item on the same rows, tops of any weight and distinct counts: one row serves them all.
    ``anywhere``: on any rows; a weight is null then where no row of its metric has the item."""
    found: dict[tuple, dict] = {}
    for n, m in enumerate(metrics):
        items = isinstance(m, (Cardinality, TopN))
        key = (m.whole, _shape(m.among), "" if anywhere else _shape(m.where), _shape(m.item.cast("string"))) if items else (n,)
        at = found.setdefault(key, {"whole": m.whole, "metrics": [], "weights": {}})
        weight = m.weight if isinstance(m, TopN) else None
        of = _shape(m.where), _shape(weight)
        at["weights"].setdefault(of, (m, weight))
        at["metrics"].append((m, list(at["weights"]).index(of)))
    for f in found.values():
        f["mixed"] = len({of[0] for of in f["weights"]}) > 1
    return list(found.values())


def row_size(metrics: Sequence[Metric]) -> int:
    """How many rows a row gives at most (:func:`_sums`), if metrics of an item share one."""
    return len(_masks(metrics)) + len(_families([m for m in metrics if not isinstance(m, Counter)], True))


def _state(name: str, kind: str, item: Column | None = None, num: Column | None = None, weight: Column | None = None) -> Column:
    null = F.lit(None)
    return F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), (null if item is None else item).cast("string").alias("item"), (null if num is None else num).cast("double").alias("num"), (F.lit(0) if weight is None else weight).cast("bigint").alias("weight"))


def _counted(df: DataFrame, masks: list[dict], keys: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """State rows of counters alone: plain sums, one for each, by key."""
    sums = []
    for i, g in enumerate(masks):
        sums.append((F.lit(1) if g["among"] is None else F.max(F.when(g["among"], 1))).alias(f"_p{i}"))
        for j, m in enumerate(g["metrics"]):
            sums.append(F.coalesce(F.sum(m.of(F.lit(1) if m.weight is None else m.weight).cast("bigint")), F.lit(0)).alias(f"_c{i}_{j}"))
    per = df.groupBy(*keys).agg(*sums)
    rows = []
    for i, g in enumerate(masks):
        for j, m in enumerate(g["metrics"]):
            one = F.struct(F.lit(m.whole).alias("_whole"), _state(m.name, "counter", weight=F.col(f"_c{i}_{j}")).alias("_s"))
            rows.append(F.when(F.col(f"_p{i}") == 1, one))
    out = per.select(*keys, F.inline(F.array_compact(F.array(*rows)))).select(*keys, "_whole", "_s.*")
    if dims and any(g["whole"] for g in masks):  # the sums of a period's groups are added up
        out = out.withColumns({d: F.when(~F.col("_whole"), F.col(d)) for d in dims}).groupBy(*keys, "name", "kind", "item", "num").agg(F.sum("weight").alias("weight"))
    return out.select(*keys, "name", "kind", "item", "num", "weight")


def _sums(df: DataFrame, masks: list[dict], families: list[dict], keys: Sequence[str], dims: Sequence[str], ts: str, at: Sequence[str] = ()) -> DataFrame:
    """``keys, m, item, num, bits, weight``: what each metric, of code ``m``, counts, summed over the rows of ``df``.

    A row of ``df`` becomes one row for each distinct weight of its counters, whose ``bits`` say which ones count it,
    and one for each item, value or second it adds to other metrics; a family of metrics (:func:`_families`) shares it,
    further weights are ``weight1`` and so on. One aggregation sums these, partly before the shuffle, or without one
    where ``df`` lies by keys, or by keys and the columns ``at``, which follow from an item.
    """
    weights = [_weight(i) for i in range(max(len(f["weights"]) for f in families))]

    def tag(code: int, item: Column, num: Column, bits: Column, *each: Column) -> Column:
        each = (*each, *[F.lit(0)] * (len(weights) - len(each)))
        return F.struct(F.lit(code).alias("m"), item.cast("string").alias("item"), num.cast("double").alias("num"), bits.cast("bigint").alias("bits"), *[w.cast("bigint").alias(n) for w, n in zip(each, weights)])

    null, one = F.lit(None), F.lit(1)
    few, made = len(masks) + len(families) <= FEW, {}

    def first(c: Column) -> Column:
        """A column of its own, worked out before the rows are made, where these are few: one method does it all otherwise."""
        if few:
            made.setdefault(repr(c), (f"_x{len(made)}", c))
        return F.col(made[repr(c)][0]) if few else c

    tags = []
    for i, g in enumerate(masks):
        bits = F.lit(0).cast("bigint")
        for j, m in enumerate(g["metrics"]):
            if isinstance(m, Counter):
                bits = bits + (F.lit(1 << j) if m.where is None else F.when(m.where, F.lit(1 << j)).otherwise(F.lit(0))).cast("bigint")
        t = tag(i, null, null, first(bits), first(_known(g["weight"])))
        tags.append(t if g["among"] is None else F.when(first(g["among"]), t))
    for k, f in enumerate(families, len(masks)):
        m, each = f["metrics"][0][0], [x.of(_known(w)) if f["mixed"] else _known(w) for x, w in f["weights"].values()]
        if f["mixed"]:
            any_of = F.lit(True) if any(x.where is None for x, _ in f["weights"].values()) else reduce(Column.__or__, [F.coalesce(x.where, F.lit(False)) for x, _ in f["weights"].values()])
            item, num = first(F.when(any_of, m.item.cast("string"))), null
        elif isinstance(m, (Cardinality, TopN)):
            item, num = first(m.of(m.item.cast("string"))), null
        elif isinstance(m, Quantile):
            item, num = null, first(m.of(m.value))
        elif isinstance(m, Histogram):
            item, num = null, first(m.of(histogram_bound(m.value, m.integer)))
        else:
            item, num, each = null, F.unix_seconds(F.col(ts).cast("timestamp")), [m.of(one if m.weight is None else m.weight)]
        each = [first(w) for w in each]
        counts = each[0] if isinstance(m, Rate) else num if isinstance(m, (Quantile, Histogram)) else item
        tags.append(F.when(counts.isNotNull(), tag(k, item, num, null, *each)))
    if few:
        rows = df.withColumns(dict(made.values())).select(*keys, *at, F.inline(F.array(*tags))).where("m is not null")
    else:
        rows = df.select(*keys, *at, F.inline(F.array_compact(F.array(*tags))))
    whole = [i for i, g in enumerate(masks) if g["whole"]] + [k for k, f in enumerate(families, len(masks)) if f["whole"]]
    if whole:
        rows = rows.withColumns({d: F.when(~F.col("m").isin(whole), F.col(d)) for d in dims})
    return rows.groupBy(*keys, *at, "m", "item", "num", "bits").agg(*[F.sum(n).alias(n) for n in weights])


def _known(weight: Column | None) -> Column:
    return F.lit(1) if weight is None else F.coalesce(weight.cast("bigint"), F.lit(0))


def _summed(sums: DataFrame) -> Column:
    """True of any row. The test needs all its sums, so what it guards stays above their aggregation, whose shuffle is read again and not made again."""
    return F.coalesce(*[F.col(c) for c in sums.columns if c.startswith("weight")]).isNotNull()


def _weight(i: int) -> str:
    return f"weight{i or ''}"


def _bit(j: int) -> Column:
    return F.when(F.col("bits").bitwiseAND(F.lit(1 << j).cast("bigint")) != 0, F.col("weight")).otherwise(F.lit(0))


def _unmasked(sums: DataFrame, masks: list[dict], keys: Sequence[str]) -> DataFrame:
    """The values of all counters, from sums by mask: added up by key first, taken apart then."""
    width = max(len(g["metrics"]) for g in masks)
    rows = sums.where(F.when(_summed(sums), F.col("bits").isNotNull()))
    wide = rows.groupBy(*keys, "m").agg(*[F.sum(_bit(j)).alias(f"_c{j}") for j in range(width)])
    one = lambda m, j: F.struct(F.lit(m.name).alias("name"), F.lit("counter").alias("kind"), F.lit("value").alias("stat"), F.col(f"_c{j}").cast("double").alias("value"))
    each = [F.array(*[one(m, j) for j, m in enumerate(g["metrics"]) if isinstance(m, Counter)]) for g in masks]
    return wide.select(*keys, F.inline(F.element_at(F.array(*[e if any(isinstance(m, Counter) for m in g["metrics"]) else F.lit(None).cast("array<struct<name:string,kind:string,stat:string,value:double>>") for e, g in zip(each, masks)]), F.col("m") + 1)))


def _states(sums: DataFrame, masks: list[dict], families: list[dict], keys: Sequence[str], counters: bool = True, codes: Sequence[int] | None = None) -> DataFrame:
    """State rows that add up by name, item and num. Without ``counters``, masks only show which distinct counts may be 0.
    ``codes`` of the families, if they don't follow those of the masks; ``sums`` has no others then."""
    states, kept = None, []
    for i, g in enumerate(masks):
        each = []
        for j, m in enumerate(g["metrics"]):
            if not isinstance(m, Counter):
                each.append(_state(m.name, "cardinality"))
            elif counters:
                each.append(_state(m.name, "counter", weight=_bit(j)))
        if each:
            kept.append(i)
            states = F.when(F.col("m") == i, F.array(*each)) if states is None else states.when(F.col("m") == i, F.array(*each))
    if codes is None and len(kept) < len(masks):
        sums = sums.where(F.when(_summed(sums), (F.col("m") >= len(masks)) | F.col("m").isin(kept)))
    code = F.col("m") - len(masks)
    if codes is not None or sum(len(f["metrics"]) for f in families) <= 2 * FEW:  # by compiled code
        named = None
        for k, f in zip(codes or range(len(masks), len(masks) + len(families)), families):
            each = F.array(*[F.struct(F.lit(m.name).alias("name"), F.lit(type(m).__name__.lower()).alias("kind"), F.col("item"), F.col("num"), F.col(_weight(i)).alias("weight")) for m, i in f["metrics"]])
            named = F.when(F.col("m") == k, each) if named is None else named.when(F.col("m") == k, each)
        out = sums.select(*keys, F.inline(named if states is None else F.coalesce(states, named)))
        return out.where("weight is not null") if any(f["mixed"] for f in families) else out
    label = lambda m, i: F.struct(F.lit(m.name).alias("name"), F.lit(type(m).__name__.lower()).alias("kind"), F.lit(i).alias("i"))
    labels = F.get(F.array(*[F.array(*[label(m, i) for m, i in f["metrics"]]) for f in families]), code)
    weights = F.array(*[F.col(_weight(i)) for i in range(max(len(f["weights"]) for f in families))])
    named = F.transform(labels, lambda x: F.struct(x["name"].alias("name"), x["kind"].alias("kind"), F.col("item").alias("item"), F.col("num").alias("num"), F.get(weights, x["i"]).alias("weight")))
    out = sums.select(*keys, F.inline(named if states is None else states.otherwise(named)))
    return out.where("weight is not null") if any(f["mixed"] for f in families) else out


def _parts(df: DataFrame, metrics: Sequence[Metric], keys: Sequence[str], dims: Sequence[str], ts: str) -> DataFrame:
    masks, others = _masks(metrics), [m for m in metrics if not isinstance(m, Counter)]
    families = _families(others)
    return _states(_sums(df, masks, families, keys, dims, ts), masks, families, keys) if others else _counted(df, masks, keys, dims)


def _exact(df: DataFrame, metrics: Sequence[Metric], keys: Sequence[str], dims: Sequence[str], ts: str, topn: int, threshold: int, at: Sequence[str] | None = None, groups: DataFrame | None = None, mixed: bool = False) -> DataFrame:
    """The statistics of all metrics, straight from the sums."""
    if at is not None:
        return _placed(df, metrics, keys, dims, ts, topn, threshold, at, groups)
    masks, others = _masks(metrics), [m for m in metrics if not isinstance(m, Counter)]
    if not others:
        return _counted(df, masks, keys, dims).select(*keys, "name", "kind", F.lit("value").alias("stat"), F.col("weight").cast("double").alias("value"))
    families = _families(others, mixed)
    sums = _sums(df, masks, families, keys, dims, ts)
    rest = statistics(_states(sums, masks, families, keys, counters=False), keys, topn, threshold, {type(m).__name__.lower() for m in others})
    return rest if len(others) == len(metrics) else rest.unionByName(_unmasked(sums, masks, keys))


def _placed(df: DataFrame, metrics: Sequence[Metric], keys: Sequence[str], dims: Sequence[str], ts: str, topn: int, threshold: int, at: Sequence[str], groups: DataFrame | None) -> DataFrame:
    """The same of rows that lie by keys, or by keys and ``at``: sums need no further shuffle, and tops share no step with
    other metrics, so each ranks or counts its own sums alone. With ``at`` there are no counters, and distinct counts take their zeros from ``groups``."""
    masks, others = [] if at else _masks(metrics), [m for m in metrics if not isinstance(m, Counter)]
    families = _families(others, True)
    sums = _sums(df, masks, families, keys, dims, ts, at)
    parts = []
    for top in (True, False):
        mine = [{**f, "metrics": [(m, i) for m, i in f["metrics"] if isinstance(m, TopN) == top]} for f in families]
        kinds = {type(m).__name__.lower() for f in mine for m, _ in f["metrics"]}
        if not kinds:
            continue
        codes = [k for k, f in enumerate(mine, len(masks)) if f["metrics"]]
        zeros = [i for i, g in enumerate(masks) if not top and any(isinstance(m, Cardinality) for m in g["metrics"])]
        states = _states(sums.where(F.col("m").isin(zeros + codes)), [] if top else masks, [f for f in mine if f["metrics"]], keys, counters=False, codes=codes)
        if groups is not None and "cardinality" in kinds:
            none = F.array(*[_state(m.name, "cardinality") for m in others if isinstance(m, Cardinality)])
            states = states.unionByName(groups.select(*keys).distinct().select(*keys, F.inline(none)))
        parts.append(statistics(states, keys, topn, threshold, kinds))
    if len(others) < len(metrics):
        parts.append(_unmasked(sums, masks, keys))
    return reduce(DataFrame.unionByName, parts)


def metric_states(df: DataFrame, metrics: Sequence[Metric], keys: Sequence[str] = ("period_start", "period_len"), dims: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """The mergeable form of all metrics: ``keys, dims, name, kind, item, num, weight``.

    Weights of equal rows add up, whatever the split of the events: over micro-batches, shards, or periods that become
    one. A counter is one row; distinct counts and tops have a row an item, quantiles one a value, histograms one a
    bound, rates one a second. :func:`statistics` reads them.
    """
    return add_states(_parts(df, metrics, [*keys, *dims], dims, ts), [*keys, *dims])


def add_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    return states.groupBy(*keys, "name", "kind", "item", "num").agg(F.sum("weight").alias("weight"))


def statistics(states: DataFrame, keys: Sequence[str], topn: int = 10, threshold: int = 0, kinds: set[str] | None = None) -> DataFrame:
    """``keys, name, kind, stat, value`` of state rows, among whose keys are ``period_start`` and ``period_len``.

    Sums, distinct counts, and what is bounded by the period (seconds, histogram bounds) come from one aggregation by
    metric; tops are ranked and quantiles selected from the summed items and values. ``live``, of rates, is the total of
    the latest complete second: the one before the newest second there is, if it is in the newest period.
    """
    kinds = kinds or {"counter", "cardinality", "topn", "quantile", "histogram", "rate"}
    # the tests need the sums, so they stay above the aggregation and its shuffle is read again, not made again
    of = lambda *some: states if kinds <= {*some} else states.where(F.when(F.col("weight").isNotNull(), F.col("kind").isin(*some)))
    one = lambda stat, value: F.struct((F.lit(stat) if isinstance(stat, str) else stat).alias("stat"), value.cast("double").alias("value"))
    parts = []
    if plain := sorted(kinds & {"counter", "cardinality", "quantile"}):
        seen = of(*plain).groupBy(*keys, "kind", "name").agg(F.sum("weight").alias("_sum"), F.count("item").alias("_items"), F.min("num").alias("_low"), F.max("num").alias("_high"))
        stats = F.when(F.col("kind") == "counter", F.array(one("value", F.col("_sum")))).when(F.col("kind") == "cardinality", F.array(one("value", F.col("_items"))))
        stats = stats.otherwise(F.array(one("n", F.col("_sum")), one("min", F.col("_low")), one("max", F.col("_high"))))
        parts.append(seen.select(*keys, "name", "kind", F.inline(stats)))
    if paired := sorted(kinds & {"rate", "histogram"}):
        seen = of(*paired).groupBy(*keys, "kind", "name").agg(F.array_sort(F.collect_list(F.struct("num", "weight"))).alias("_pairs"))
        seen = seen.withColumn("_totals", F.array_sort("_pairs.weight"))
        # running counts over at most 486 bounds
        upto = F.transform("_pairs", lambda x, i: one(x["num"].cast("string"), F.aggregate(F.slice("_pairs", F.lit(1), i + 1), F.lit(0).cast("bigint"), lambda a, y: a + y["weight"])))
        stats = F.when(F.col("kind") == "histogram", F.concat(upto, F.array(one("+Inf", F.aggregate("_totals", F.lit(0).cast("bigint"), lambda a, y: a + y)))))
        if "rate" in kinds:
            clock = of("rate").where("kind = 'rate'").agg(F.max("num").alias("_clock"), F.max("period_start").alias("_open"))
            seen = seen.crossJoin(F.broadcast(clock))  # one row
            rows = F.size("_pairs")
            seconds = F.greatest(F.col("period_len"), rows)
            marks = []
            for q, p in QUANTILES:  # seconds without rows count zero
                place = F.greatest(F.ceil(seconds * p), F.lit(1)) - (seconds - rows)
                marks.append(one(q, F.when(place < 1, F.lit(0)).otherwise(F.get("_totals", (place - 1).cast("int")))))
            last = F.col("_clock") - 1
            live = F.coalesce(F.get(F.filter("_pairs", lambda x: x["num"] == last), F.lit(0))["weight"], F.lit(0))
            open_ = (F.col("period_start") == F.col("_open")) & (last >= F.unix_seconds(F.col("period_start").cast("timestamp")))
            stats = stats.otherwise(F.array(*marks, one("live", F.when(open_, live))))
        parts.append(seen.select(*keys, "name", "kind", F.inline(stats)))
    if "quantile" in kinds:
        found = percentiles_of(of("quantile"), [*keys, "name"], "num", [p for _, p in QUANTILES], "weight")
        marks = F.array(*[F.struct(F.lit(q).alias("stat"), F.get("marks", F.lit(i)).cast("double").alias("value")) for i, (q, _) in enumerate(QUANTILES)])
        parts.append(found.select(*keys, "name", F.lit("quantile").alias("kind"), F.inline(marks)))
    if "topn" in kinds:
        ranked = top_n(of("topn"), [*keys, "name"], "item", "weight", topn, threshold, summed=True)
        parts.append(ranked.select(*keys, "name", F.lit("topn").alias("kind"), F.col("item").alias("stat"), F.col("estimate").cast("double").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def _sketched(df: DataFrame, metrics: Sequence[Metric], keys: Sequence[str], topn: int = 10) -> DataFrame:
    """Distinct counts, quantiles and tops of mergeable sketches, in one aggregation of bounded state a group."""
    aggs, rows, tops = [], [], []
    one = lambda m, kind, stat, value: F.struct(F.lit(m.name).alias("name"), F.lit(kind).alias("kind"), (F.lit(stat) if isinstance(stat, str) else stat).alias("stat"), value.cast("double").alias("value"))
    for i, m in enumerate(metrics):
        a = f"_a{i}"
        if isinstance(m, Cardinality):
            aggs.append(F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(m.of(m.item))), F.lit(0)).alias(a))
            rows.append(one(m, "cardinality", "value", F.col(a)))
        elif isinstance(m, TopN):
            df = df.withColumn(f"_i{i}", m.of(m.item.cast("string")))
            aggs.append(F.expr(f"approx_top_k(_i{i}, {topn}, {TRACKED}) FILTER (WHERE _i{i} IS NOT NULL)").alias(a))
            tops.append((m, a))
        else:
            v = m.of(m.value).cast("double")
            aggs += [F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(v), F.array(*[F.lit(p) for _, p in QUANTILES])).alias(a), F.count(v).alias(a + "n"), F.min(v).alias(a + "min"), F.max(v).alias(a + "max")]
            rows += [one(m, "quantile", q, F.try_element_at(a, F.lit(j + 1))) for j, (q, _) in enumerate(QUANTILES)]
            rows += [one(m, "quantile", "n", F.when(F.col(a + "n") > 0, F.col(a + "n"))), one(m, "quantile", "min", F.col(a + "min")), one(m, "quantile", "max", F.col(a + "max"))]
    each = F.array(*rows) if rows else F.array().cast("array<struct<name:string,kind:string,stat:string,value:double>>")
    listed = lambda m, a: F.transform(F.coalesce(a, F.array().cast("array<struct<item:string,count:bigint>>")), lambda t: one(m, "topn", t["item"], t["count"]))
    for m, a in tops:
        each = F.concat(each, listed(m, a))
    return df.groupBy(*keys).agg(*aggs).select(*keys, F.inline(each))


def metric_table(df: DataFrame, metrics: Sequence[Metric], *, handler: str, schema: str, policy: str = "default", dims: Sequence[str] = (), topn: int = 10, threshold: int = 0, mode: str = "exact", ts: str = "ts", at: Sequence[str] | None = None, groups: DataFrame | None = None, mixed: bool = False) -> DataFrame:
    """All metrics of ``df`` (with ``period_start``, ``period_len`` and the dimensions) in the long form.

    Mode ``exact`` counts distinct values, ranks items and takes percentiles exactly; ``sketch`` uses mergeable sketches
    for distinct counts, quantiles and tops of unit weight, in one more pass; ``states`` gives what :func:`metric_states`
    does, with the labels as ``entries``, for :func:`read_states`. A metric that is ``whole`` has no dimensions.

    ``mixed``: exact metrics of an item share a row though they count other rows of it, for tables of few such metrics.
    ``at``, of exact tops, distinct counts and counters: rows of a group lie in one partition already (empty), or those of
    a group with the same values of these columns, which follow from any item; distinct counts then need ``groups``, rows
    of all groups. Elsewhere a sum is shuffled to where it belongs, so the results are the same wherever rows lie. It implies ``mixed``.
    """
    if not metrics:
        return df.sparkSession.createDataFrame([], STATES if mode == "states" else SCHEMAS["metrics"])
    keys = ["period_start", "period_len", *dims]
    sketched = lambda m: mode == "sketch" and (isinstance(m, (Cardinality, Quantile)) or isinstance(m, TopN) and m.weight is None)
    by_sketch, exact = [m for m in metrics if sketched(m)], [m for m in metrics if not sketched(m)]
    entries = F.filter(F.array(*[F.struct(F.lit(d).alias("key"), F.col(d).cast("string").alias("value")) for d in dims]), lambda e: e["value"].isNotNull()) if dims else F.array().cast("array<struct<key:string,value:string>>")
    named = [F.lit(policy).alias("policy"), F.lit(handler).alias("handler"), F.lit(schema).alias("schema"), "period_start", "period_len"]
    if mode == "states":
        return metric_states(df, metrics, dims=dims, ts=ts).select(*named, entries.alias("entries"), "name", "kind", "item", "num", "weight")
    parts: list[DataFrame] = []
    if exact:
        parts.append(_exact(df, exact, keys, dims, ts, topn, threshold, at, groups, mixed))
    for whole in (False, True):
        if some := [m for m in by_sketch if m.whole == whole]:
            source = df if some[0].among is None else df.where(some[0].among)
            parts.append(_sketched(source.withColumns({d: F.lit(None).cast("string") for d in dims}) if whole else source, some, keys, topn))
    out = reduce(DataFrame.unionByName, parts).where("value is not null")
    return out.select(*named, F.map_from_entries(entries).alias("labels"), "name", "kind", "stat", "value")


#: The mergeable form of metric tables.
STATES = "policy string, handler string, schema string, period_start timestamp, period_len bigint, entries array<struct<key:string,value:string>>, name string, kind string, item string, num double, weight bigint"
STATE_KEYS = ["policy", "handler", "schema", "period_start", "period_len", "entries"]


def read_states(states: DataFrame, topn: int = 10, threshold: int = 0) -> DataFrame:
    """The long form of states that metric tables of mode ``states`` gave, in any number of parts."""
    out = statistics(add_states(states, STATE_KEYS), STATE_KEYS, topn, threshold).where("value is not null")
    return out.select(*STATE_KEYS[:-1], F.map_from_entries("entries").alias("labels"), "name", "kind", "stat", "value")


def delta_sum(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Sum of the increases of a counter over its running maximum, for each of ``keys``; the first value is the base."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.select(*keys, F.greatest(F.col(value) - before, F.lit(0)).alias("d")).groupBy(*keys).agg(F.coalesce(F.sum("d"), F.lit(0)).alias("delta"))


def clamped_running_total(df: DataFrame, delta: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with ``total``: the running sum of ``delta`` that a removal can't take below zero.

    In closed form: the plain running sum less its lowest value so far where that is negative.
    """
    summed = running_sum(df, delta, keys, order, out="_sum", low="_least")
    return summed.withColumn("total", F.col("_sum") - F.least(F.col("_least"), F.lit(0))).drop("_sum", "_least")


def min_max(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"))


def event_counts(df: DataFrame, keys: Sequence[str], deep: Column) -> DataFrame:
    """``num_events`` (all rows, filtered ones too) and ``num_samples`` (rows with the deep flag)."""
    return df.groupBy(*keys).agg(F.count("*").alias("num_events"), F.count_if(deep).alias("num_samples"))
