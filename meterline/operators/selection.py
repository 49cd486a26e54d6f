"""Exact order statistics without one sorter a group: values are dealt to ranges, counted, and only the ranges that hold
a wanted rank are sorted."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of each doubling of a value.
RANGES = 256


def value_range(value: Column) -> Column:
    """A number that never falls as the value grows: 256 ranges between a value and its double. At most 1.1 million in all."""
    v = value.cast("double")
    place = lambda x: F.floor(F.least(F.log2(x), F.lit(2000.0)) * RANGES).cast("bigint") + 1100 * RANGES
    return F.when(v > 0, place(v)).when(v < 0, -place(-v)).otherwise(F.lit(0))


def same_keys(keys: Sequence[str], left: str = "", right: str = "") -> Column:
    """Equality of all keys, null equal to null."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}{k}").eqNullSafe(F.col(f"{right}{k}")) for k in keys], F.lit(True))


def percentiles_of(df: DataFrame, keys: Sequence[str], value: str, marks: Sequence[float], weight: str | None = None) -> DataFrame:
    """``keys, marks``: inclusive percentiles as an array, the smallest value whose cumulative share reaches each mark.

    Every row counts once, or ``weight`` times; null values don't count, and a group without values has no row. Exact.
    Values are summed by value, then by range; running counts over the ranges of a group show which ranges hold the
    wanted ranks, and only their values are ordered, range by range. So no task orders a group's values as such.
    """
    number = F.sum(weight) if weight else F.count("*")
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(number.alias("_w")).where("_w > 0").withColumn("_range", value_range(F.col(value)))
    by = Window.partitionBy(*(keys or [F.lit(0)]))
    ranges = counts.groupBy(*keys, "_range").agg(F.sum("_w").alias("_n"))
    ranges = ranges.withColumns({"_upto": F.sum("_n").over(by.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_all": F.sum("_n").over(by)})
    wanted = lambda p: F.greatest(F.ceil(F.col("_all") * p), F.lit(1))
    holds = reduce(lambda a, b: a | b, [(F.col("_upto") >= wanted(p)) & (F.col("_upto") - F.col("_n") < wanted(p)) for p in marks])
    ranges = ranges.where(holds).select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_range").alias("_of__range"), (F.col("_upto") - F.col("_n")).alias("_before"), "_all")
    inside = counts.join(ranges, same_keys([*keys, "_range"], right="_of_"))
    order = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("_place", F.col("_before") + F.sum("_w").over(order))
    at = [F.max(F.when((F.col("_place") >= wanted(p)) & (F.col("_place") - F.col("_w") < wanted(p)), F.col(value))) for p in marks]
    return inside.groupBy(*keys).agg(F.array(*at).alias("marks")).where(F.get("marks", F.lit(0)).isNotNull())
