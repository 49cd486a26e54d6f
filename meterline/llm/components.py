"""Connected components of an edge table by alternating large-star and small-star steps.

Each step only groups, joins and removes duplicates; nothing is collected. Every round is written to the shared
folder, so a lost executor costs at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, node: str = "node", component: str = "component") -> DataFrame:
    """``node, component`` of every node that has an edge to another; component is the least node reachable.

    ``edges`` has two columns of one orderable type. Loops, repeated and reversed edges and rows with a null end
    change nothing; an empty table gives an empty table.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where((F.col(a) != F.col(b)) & F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    e = materialize(e, "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        old, e = e, materialize(small, "edges")
        discard(old)
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias(node), F.col("v").alias(component)).unionByName(e.select(F.col("v").alias(node), F.col("v").alias(component)).distinct())
