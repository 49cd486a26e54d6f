"""Mixing sources to target weights (operator 10): weighted fair queueing with DataFrame operations only.

Every source serves its documents in a fixed shuffled order, as often as it may repeat them. A served copy ends at
the virtual time ``words its source has served so far / target of its source``. All copies in order of that time
are the mix; it ends at the total budget.

Running sums are made in two levels (sums of small hash ranges first, then inside each range), so no task holds a
whole source, however large. The queue of all copies is sorted by range partitions of that time, and written; the sums
of partitions tell in which one the budget ends, and only inside that one words are counted copy by copy.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import col, materialize

#: Documents in one hash range of a source, and copies in one range of the queue, about; both grow in number with the table.
IN_RANGE, IN_SLICE = 2000, 1_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeat: int = 2) -> DataFrame:
    """``source, source_size, target`` for each source of ``sizes(source, size)``.

    Sources in code-point order, null last, take the weights in turn and share ``share`` times all words; a target
    stops at ``repeat`` times its source's size and the excess goes to the others by weight. Solved in closed form:
    in order of cap / weight, the sources before the first that its share doesn't fill are at their caps.
    One row a source; both windows sort that small table only.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    s = totals.select("source", "source_size", weight.alias("w"), (F.col("source_size") * float(repeat)).alias("cap"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    s = s.select("*", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("full"), F.sum("w").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("rest"), (F.sum("source_size").over(Window.partitionBy(F.lit(0))) * share).alias("budget"))
    s = s.withColumn("level", (F.col("budget") - F.col("full")) / F.col("rest"))
    level = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("full"), F.col("level")))).over(Window.partitionBy(F.lit(0)))
    return s.withColumn("at", level["level"]).select("source", "source_size", F.least("cap", F.coalesce(F.col("at") * F.col("w"), F.col("cap"))).alias("target"))


def mix_sources(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeat: int = 2, seed: str = "mix") -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every document; taken = size * copies.

    Order inside a source: md5 of seed and id, then id, then size; equal rows are interchangeable. Null texts have size 0, null
    sources are one source of their own, null ids count as the empty id. Sources without words have target 0 and
    take nothing; an empty table gives an empty table. Other columns are ignored.
    """
    sizes = documents.select(col(doc_id).alias("doc_id"), col(source).cast("string").alias("source"), word_count(col(text).cast("string")).alias("size"))
    sizes = materialize(sizes.withColumn("key", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))), "sizes")
    number = sizes.count()
    digits = max(1, math.ceil(math.log(max(number / IN_RANGE, 1), 16)))
    sizes = sizes.withColumn("range", F.substring("key", 1, digits))
    targets = source_targets(sizes, weights=weights, share=share, repeat=repeat).withColumnRenamed("source", "s")
    ranges = sizes.groupBy("source", "range").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    ranges = ranges.alias("a").join(targets.alias("b"), F.col("a.s").eqNullSafe(F.col("b.s"))).select("a.s", "r", "offset", "source_size", "target")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    served = sizes.withColumn("served", F.sum("size").over(inside))
    served = served.join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    ends = F.transform(F.sequence(F.lit(0), F.lit(repeat - 1)), lambda n: (F.col("served") + F.col("offset") + n * F.col("source_size")) / F.col("target"))
    queue = served.select("doc_id", "source", "size", "key", "source_size", "target", F.when((F.col("target") > 0) & (F.col("size") > 0), ends).otherwise(F.array().cast("array<double>")).alias("ends"))
    queue = materialize(queue, "queue")
    place = ["end", "source_order", "key", "n"]
    named = F.coalesce("source", F.lit("\U0010ffff")).alias("source_order")  # null last
    copies = queue.select("size", named, "key", F.posexplode("ends").alias("n", "end"))
    slices = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-number * repeat // IN_SLICE))
    ordered = copies.repartitionByRange(slices, *place).sortWithinPartitions(*place)
    ordered = materialize(ordered.withColumn("slice", F.spark_partition_id()), "order")
    upto = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ordered.groupBy("slice").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(upto))  # one row a slice
    budget = queue.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] * share
    cut = sums.where(F.col("upto") > budget).orderBy("slice").select("slice", (F.lit(budget) - F.col("upto") + F.col("words")).alias("room")).first()
    if cut is None:  # everything fits
        return queue.select("doc_id", "source", "size", "source_size", "target", F.size("ends").alias("copies"), (F.col("size") * F.size("ends")).cast("bigint").alias("taken"))
    # the first copy that no longer fits: one bounded slice
    inside = ordered.where(F.col("slice") == cut["slice"]).withColumn("words", F.sum("size").over(Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = inside.where(F.col("words") > cut["room"]).orderBy(*place).select(*place).first()
    out_of = F.struct(*[F.lit(first[c]).cast(ordered.schema[c].dataType).alias(c) for c in place])
    bound = lambda end, n: F.struct(end.alias("end"), named, F.col("key").alias("key"), n.alias("n")) < out_of
    count = F.size(F.filter("ends", lambda end, n: bound(end, n)))
    return queue.withColumn("copies", count).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("bigint").alias("taken"))
