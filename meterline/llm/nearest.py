"""Approximate nearest neighbours by inner product (operator 7): randomly rotated one-bit codes.

A vector less the centre of its cell, r = v - c, is turned by a random rotation and kept as the signs of its
coordinates (one bit each) with three scalars: its length, the inner product of its direction with the code, and its
inner product with c. For a query q the code estimates <q, r>, and the error of the estimate is bounded by ``width``
standard deviations, known for each code. Only vectors whose upper bound reaches the k-th best lower bound are reranked
with the original vectors.

A bounded sample gives the cells' centres, and each query a floor: its k-th best in the sample, which the k-th best of
all rows reaches. A query visits the cells that can reach its floor, <q, c> + |q| * radius; that bound is exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .tables import col, materialize

#: Queries and rows that meet in one task at once.
QUERY_BLOCK, ROW_BLOCK = 16_384, 4096
#: Queries scored against the whole sample at once: a matrix of 16 MB.
VISIT_BLOCK = 256
#: Rows of the sample, and cells, at most.
SAMPLE, CELLS = 8192, 1024


def rotation(d: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same for a seed everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _usable(vector: Column) -> Column:
    """Not null or empty, all components finite, at least one not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def vectors_of(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """``vec_id, v`` (components as 64-bit bytes) of the vectors that take part, and their dimension.

    Vectors null, empty, zero or with null or non-finite components take no part, nor do those of another length
    than most (the smaller length on a tie), nor rows without id.
    """
    rows = embeddings.select(col(vec_id).alias("vec_id"), col(vector).cast("array<double>").alias("x")).where(F.col("vec_id").isNotNull() & _usable(F.col("x")))
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = most["d"] if most else 0

    def run(batches):
        for batch in batches:
            flat = np.asarray(batch.column(1).flatten()).astype("<f8").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([flat[8 * d * i : 8 * d * (i + 1)] for i in range(batch.num_rows)], pa.binary())], names=["vec_id", "v"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.where(F.size("x") == d).mapInArrow(run, f"vec_id {kind}, v binary"), d


def _distinct(vectors: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the rows of the ``k + 1`` smallest ids, at most ``k`` of each id: no others can be among the k
    nearest of any query. Ranks are limited before the shuffle too."""
    kept = vectors.withColumn("r", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    again = F.row_number().over(Window.partitionBy("v", "vec_id").orderBy("r"))
    return kept.withColumn("n", again).where(F.col("n") <= k).select("vec_id", "v")


def centres(sample: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """k-means on the rows of the sample; the first centres are spread evenly over it."""
    c = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        own = cell_of(sample, c)
        counts = np.bincount(own, minlength=cells)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        c[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return c


def cell_of(matrix: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    return np.argmin((c * c).sum(axis=1)[None, :] - 2 * matrix @ c.T, axis=1)


def encode(matrix: np.ndarray, center: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits, and (length, <code, direction>, <v, center>) of each row; ``center`` is one or a row's own."""
    r = matrix - center
    length = np.sqrt((r * r).sum(axis=1))
    t = r @ turn.T
    align = np.abs(t).sum(axis=1) / np.sqrt(matrix.shape[1]) / np.maximum(length, 1e-300)
    return np.packbits(t > 0, axis=1), np.stack([length, align, (matrix * center).sum(axis=1)], axis=1)


def estimate(queries: np.ndarray, center: np.ndarray, turn: np.ndarray, bits: np.ndarray, scalars: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x codes) and their error bounds."""
    d = queries.shape[1]
    signs = np.unpackbits(bits, axis=1, count=d).astype(np.float32) * 2 - 1
    q = queries @ turn.T
    length, align = scalars[:, 0], np.maximum(scalars[:, 1], 1e-12)
    code = (q.astype(np.float32) @ signs.T).astype(np.float64) / np.sqrt(d)  # <q, code>
    guess = code * (length / align) + queries @ center[:, None]
    spread = length * np.sqrt(np.maximum(1 - align**2, 0)) / align / np.sqrt(max(d - 1, 1))
    return guess, width * np.sqrt((queries * queries).sum(axis=1))[:, None] * spread[None, :] + 1e-5 * (1 + np.abs(guess))


def search(embeddings: DataFrame, is_query: Column, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20, width: float = 5.0, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK, sample: int = SAMPLE) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row, its k nearest among all other rows.

    Nearness is the inner product in double precision, ties to the smaller id; fewer candidates give fewer rows.
    ``width`` standard deviations bound an estimate's error: larger finds more and reranks more. Every row is coded and
    in a cell; the sample (the ``sample`` rows of smallest hash) only gives centres and floors. Queries and rows meet in
    blocks of bounded size, which return what reaches the query's floor, at most k rows a query. See
    :func:`vectors_of` for vectors that take no part. Rows that repeat an id are candidates each, and queries each: such
    a query id has k rows, ranked 1 to k, for each of its rows.
    """
    ship(embeddings.sparkSession)
    vectors, d = vectors_of(embeddings, vec_id, vector)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not d:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    spark = vectors.sparkSession
    few = _distinct(vectors, k).withColumn("h", F.xxhash64("v", "vec_id"))
    few = materialize(few, "vectors")
    drawn = few.orderBy("h", "vec_id").select("vec_id", "v").limit(sample).collect()
    known = np.frombuffer(b"".join(r["v"] for r in drawn), "<f8").reshape(-1, d)
    names = np.array([r["vec_id"] for r in drawn])
    n = few.count()
    middle = centres(known, int(min(CELLS, max(1, -(-n // row_block)), len(known))))
    turn = rotation(d)
    shared = spark.sparkContext.broadcast((known, names, middle))

    def code(batches):
        c = shared.value[2]
        for batch in batches:
            if batch.num_rows:
                m = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<f8").reshape(-1, d)
                cell = cell_of(m, c)
                bits, scalars = encode(m, c[cell], turn)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(scalars[:, 0]), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array([s.tobytes() for s in scalars], pa.binary())], names=["vec_id", "v", "cell", "length", "bits", "scalars"])

    coded = few.select("vec_id", "v").mapInArrow(code, f"vec_id {kind}, v binary, cell int, length double, bits binary, scalars binary")
    index = materialize(coded, "codes")
    sizes = {r["cell"]: (r["n"], r["radius"]) for r in index.groupBy("cell").agg(F.count("*").alias("n"), F.max("length").alias("radius")).collect()}  # a row a cell
    filled = np.array([i in sizes for i in range(len(middle))])
    radius = np.array([sizes.get(i, (0, 0.0))[1] for i in range(len(middle))])

    def visit(batches):
        rows, ids, c = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            for s in range(0, batch.num_rows, VISIT_BLOCK):
                part = batch.slice(s, VISIT_BLOCK)
                own = np.array(part.column(0).to_pylist())
                q = np.frombuffer(b"".join(part.column(1).to_pylist()), "<f8").reshape(-1, d)
                score = q @ rows.T
                score[own[:, None] == ids[None, :]] = -np.inf
                floor = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(q), -np.inf)
                floor = floor - 1e-9 * (1 + np.abs(floor))  # sums in another order
                reach = q @ c.T + np.sqrt((q * q).sum(axis=1))[:, None] * radius[None, :]
                cells = [np.flatnonzero((r >= f) & filled).tolist() for r, f in zip(reach + 1e-9 * (1 + np.abs(reach)), floor)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(floor), pa.array(cells, pa.list_(pa.int32()))], names=["vec_id", "v", "floor", "cells"])

    asked = vectors.where(is_query).mapInArrow(visit, f"vec_id {kind}, v binary, floor double, cells array<int>")
    asked = materialize(asked.withColumn("key", F.monotonically_increasing_id()), "queries")  # written, so a row keeps its key
    each = asked.select("key", "vec_id", "v", "floor", F.explode("cells").alias("cell"))
    blocks = each.groupBy("cell").agg(F.ceil(F.count("*") / query_block).cast("int").alias("qbs"))
    blocks = blocks.join(F.broadcast(spark.createDataFrame([(i, -(-c // row_block)) for i, (c, _) in sizes.items()], "cell int, rbs int")), "cell")
    blocks = F.broadcast(blocks)  # a row a cell, CELLS at most: rows are not dealt by cell
    spread = lambda what, number: F.pmod(F.xxhash64(what), F.col(number)).cast("int")
    upto = lambda number: F.explode(F.sequence(F.lit(0), F.col(number) - 1))
    none = F.lit(None).cast("binary")
    a = index.join(blocks, "cell").select("cell", spread(F.struct("vec_id", "v"), "rbs").alias("rb"), upto("qbs").alias("qb"), F.lit(False).alias("is_query"), F.lit(None).cast("bigint").alias("key"), "vec_id", "v", F.lit(None).cast("double").alias("floor"), "bits", "scalars")
    b = each.join(blocks, "cell").select("cell", upto("rbs").alias("rb"), spread("key", "qbs").alias("qb"), F.lit(True).alias("is_query"), "key", "vec_id", "v", "floor", none.alias("bits"), none.alias("scalars"))

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        q, r = part[part["is_query"]], part[~part["is_query"]]
        if not len(q) or not len(r):
            return pd.DataFrame({"key": q["key"][:0], "query_id": q["vec_id"][:0], "vec_id": r["vec_id"][:0], "score": np.zeros(0)})
        center = shared.value[2][part["cell"].iloc[0]]
        matrix = np.frombuffer(b"".join(r["v"]), "<f8").reshape(-1, d)
        bits = np.frombuffer(b"".join(r["bits"]), np.uint8).reshape(len(r), -1)
        scalars = np.frombuffer(b"".join(r["scalars"]), np.float64).reshape(-1, 3)
        ids, own, keys, floors = r["vec_id"].to_numpy(), q["vec_id"].to_numpy(), q["key"].to_numpy(), q["floor"].to_numpy()
        wanted = np.frombuffer(b"".join(q["v"]), "<f8").reshape(-1, d)
        found = []
        for s in range(0, len(own), 64):
            guess, error = estimate(wanted[s : s + 64], center, turn, bits, scalars, width)
            low, high = guess - error, guess + error
            for i in range(len(guess)):
                other = ids != own[s + i]
                sure = np.where(other, low[i], -np.inf)
                floor = max(floors[s + i], np.partition(sure, -k)[-k] if other.sum() > k else -np.inf)
                at = np.flatnonzero((high[i] >= floor) & other)
                score = (matrix[at] * wanted[s + i]).sum(axis=1)
                best = np.lexsort((ids[at], -score))[:k]
                best = best[score[best] >= floors[s + i]]
                found.append((np.full(len(best), keys[s + i]), np.full(len(best), own[s + i]), ids[at[best]], score[best]))
        return pd.DataFrame({c: np.concatenate([f[n] for f in found]) for n, c in enumerate(("key", "query_id", "vec_id", "score"))})

    near = a.unionByName(b).groupBy("cell", "rb", "qb").applyInPandas(meet, f"key bigint, query_id {kind}, vec_id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
