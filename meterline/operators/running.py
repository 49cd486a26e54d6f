"""Running values over long streams in two levels: short slices of the order first, then inside each slice.

No task sorts a whole stream: the sums of slices are a small table, and each slice is a window partition of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Whole numbers, and seconds, in one slice of an order.
ROWS, SECONDS = 1 << 18, 3600


def slice_of(df: DataFrame, order: str) -> Column:
    """The slice of a row: an hour of a time, or a range of a number."""
    kind = df.schema[order].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.floor(F.unix_seconds(F.col(order).cast("timestamp")) / SECONDS).cast("bigint")
    return F.floor(F.col(order) / ROWS).cast("bigint")


def _joined(df: DataFrame, before: DataFrame, keys: Sequence[str]) -> DataFrame:
    named = before.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate([*keys, "_slice"])})
    on = F.lit(True)
    for i, k in enumerate([*keys, "_slice"]):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(named, on, "left").drop(*[f"_k{i}" for i in range(len(keys) + 1)])


def _slices(keys: Sequence[str]):
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)


def running_max(df: DataFrame, value: str, keys: Sequence[str], order: str, *, out: str) -> DataFrame:
    """``df`` with ``out``: the largest value of the stream ``keys`` up to this row in ``order``."""
    sliced = df.withColumn("_slice", slice_of(df, order))
    before = sliced.groupBy(*keys, "_slice").agg(F.max(value).alias("_m")).select(*keys, "_slice", F.max("_m").over(_slices(keys)).alias("_before"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _joined(sliced.withColumn("_in", F.max(value).over(inside)), before, keys).withColumn(out, F.greatest("_before", "_in")).drop("_slice", "_before", "_in")


def running_sum(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], *, out: str, low: str) -> DataFrame:
    """``df`` with ``out``, the running sum of the stream up to this row, and ``low``, its lowest value so far."""
    sliced = df.withColumn("_slice", slice_of(df, order[0]))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = sliced.withColumn("_in", F.sum(value).over(inside)).withColumn("_low", F.min("_in").over(inside))
    slices = summed.groupBy(*keys, "_slice").agg(F.sum(value).alias("_t"), F.min("_in").alias("_m")).withColumn("_off", F.coalesce(F.sum("_t").over(_slices(keys)), F.lit(0)))
    slices = slices.select(*keys, "_slice", "_off", F.min(F.col("_off") + F.col("_m")).over(_slices(keys)).alias("_floor"))
    both = _joined(summed, slices, keys)
    return both.withColumn(out, F.col("_off") + F.col("_in")).withColumn(low, F.least("_floor", F.col("_off") + F.col("_low"))).drop("_slice", "_in", "_low", "_off", "_floor")


def latest(marks: DataFrame, asked: DataFrame, keys: Sequence[str], order: str, value: str, wide: Column | None = None) -> DataFrame:
    """``asked`` with ``value``: the largest one of the ``marks`` of its ``keys`` up to its place in ``order`` (whole numbers).

    Marks and questions meet slice by slice; what earlier slices hold is one value a slice, of the keys that are ``wide``:
    the places of the others, doubled, lie in one slice. Marks are shuffled once. No key and no place is null.
    """
    own = [c for c in asked.columns if c not in (*keys, order)]
    place = F.col(order).cast("bigint")
    rows = marks.select(*keys, (place * 2).alias("_at"), F.lit(None).cast(T.StructType([asked.schema[c] for c in own])).alias("_row"), F.col(value).alias("_v"))
    questions = asked.select(*keys, (place * 2 + 1).alias("_at"), F.struct(*own).alias("_row"), F.lit(None).cast(marks.schema[value].dataType).alias("_v"))
    slice_ = F.floor(F.col("_at") / ROWS).cast("bigint").alias("_slice")
    wide = F.lit(True) if wide is None else wide
    before = rows.where(wide).groupBy(*keys, slice_).agg(F.max("_v").alias("_m"))
    # a slice's question looks at the slices before it: these are asked for by slice, so that all slices are in the list
    listed = before.unionByName(questions.where(wide).select(*keys, slice_, F.lit(None).cast(marks.schema[value].dataType).alias("_m")).distinct()).groupBy(*keys, "_slice").agg(F.max("_m").alias("_m"))
    listed = listed.select(*keys, "_slice", F.max("_m").over(_slices(keys)).alias("_before"))
    inside = Window.partitionBy(*keys, "_slice").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.unionByName(questions).select("*", slice_).withColumn("_in", F.max("_v").over(inside)).where("_row is not null").drop("_v")
    return both.join(listed, [*keys, "_slice"], "left").select(*keys, "_row.*", F.greatest("_before", "_in").alias(value))
