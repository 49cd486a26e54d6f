"""Embedding near-dedup (operator 12): lattice hashing, links by cosine, and their components.

Plan:

1. Equal vectors become one *node* with its number of copies, so a vector that a third of all rows hold is one row.
2. Each of several tables turns a node's direction at random, keeps two blocks of eight coordinates, scales them and
   decodes each block to the nearest point of the E8 lattice. The two points are the node's home cell; the cells that
   are next nearest, one step of a shortest lattice vector away, are probed too.
3. Only the keys of cells are counted first; a cell without a second node, or without a home node, is dropped before any
   vector moves. Cells of many nodes are cut into tiles by hash, and pairs of tiles meet.
4. In a tile, matrix products in double precision give the cosines. A pair that meets in several tables counts only
   where it meets first, which both codes tell. A tile gives each node's number of links and a forest of edges, never
   the pairs.
5. Components of the forest's edges, by joins and groupings.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .bytewords import mix
from .components import connected_components
from .nearest import _usable, rotation
from .tables import col, materialize, settle

#: Tables, E8 blocks of a cell, and neighbouring cells probed. Pairs of cosine 0.9 in 64 dimensions meet with 98 %.
TABLES, BLOCKS, PROBES = 8, 2, 4
#: Nodes of one tile at most.
TILE = 1024
#: Rows whose codes are made at once, and pairs looked at at once.
_ROWS, _PAIRS = 512, 20_000


@lru_cache
def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of 1 or -1, or all of 1/2 or -1/2 with an even number of signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            out.append([a if x == i else b if x == j else 0 for x in range(8)])
    out += [[s / 2 for s in signs] for signs in product((1, -1), repeat=8) if np.prod(signs) > 0]
    return np.array(out, np.float64)


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """Whole coordinates of even sum: rounded, and where the sum is odd the least certain one rounded the other way."""
    out = np.rint(y)
    rest = y - out
    odd = np.flatnonzero(out.sum(axis=1) % 2)
    worst = np.abs(rest[odd]).argmax(axis=1)
    out[odd, worst] += np.where(rest[odd, worst] >= 0, 1, -1)
    return out


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: E8 is D8 and D8 shifted by 1/2."""
    a, b = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1))[:, None], a, b)


@lru_cache
def _projection(d: int, tables: int, blocks: int) -> np.ndarray:
    """Of each table, the rows of random rotations (as many as it takes) that give its coordinates."""
    need = 8 * blocks
    return np.concatenate([np.concatenate([rotation(d, 1000 * t + i) for i in range(-(-need // d))])[:need] for t in range(tables)])


def cells(vectors: np.ndarray, cosine: float, tables: int, blocks: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the home cells (rows x tables) and of the probed ones (rows x tables x probes), as 64-bit hashes.

    Coordinates are scaled so that directions of that cosine are as far apart as the lattice's cells are wide.
    """
    n, d = vectors.shape
    scale = 0.4375 * np.sqrt(d) * np.sqrt(0.1 / max(1 - cosine, 1e-9))
    weights = np.random.default_rng(8).integers(0, 1 << 63, (tables, blocks, 8), dtype=np.int64) * 2 + 1
    salt = mix(np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(d)).view(np.int64)
    y = (scale * (vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]) @ _projection(d, tables, blocks).T).reshape(-1, 8)
    point, steps = nearest_e8(y), shortest_vectors()
    gain = ((y - point) @ steps.T).astype(np.float32)
    near = np.argpartition(-gain, probes - 1, axis=1)[:, :probes]  # of each block, its nearest other points
    key = ((2 * point).astype(np.int64).reshape(n, tables, blocks, 8) * weights).sum(axis=3)
    change = (((2 * steps).astype(np.int64)[near]).reshape(n, tables, blocks, probes, 8) * weights[:, :, None, :]).sum(axis=4)
    best = np.argsort(-np.take_along_axis(gain, near, 1).reshape(n, tables, blocks * probes), axis=2, kind="stable")[:, :, :probes]
    home = key.sum(axis=2)
    probed = home[:, :, None] + np.take_along_axis(change.reshape(n, tables, blocks * probes), best, 2)
    hashed = lambda x, s: mix((x + s).view(np.uint64)).view(np.int64)
    return hashed(home, salt[None, :]), hashed(np.ascontiguousarray(probed), salt[None, :, None])


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Vectors of length ``d`` as doubles, scaled by a power of two so that no square overflows."""
    m = np.asarray(column.flatten()).astype(np.float64).reshape(-1, d)
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1))[1][:, None])


def _pairs_within(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows inside consecutive groups of these sizes."""
    n = sizes.sum()
    place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    more = np.repeat(sizes, sizes) - 1 - place
    left = np.repeat(np.arange(n), more)
    return left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(more) - more, more)


class Tiles:
    """Links inside tiles: what :func:`lattice_links` runs on rows of the same key and pair of parts."""

    def __init__(self, cosine: float, tables: int, blocks: int, probes: int):
        self.cosine, self.shape = cosine, (tables, blocks, probes)

    def linked(self, x: np.ndarray, sizes: np.ndarray, home: np.ndarray, part: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows of a group whose cosine is enough, one of them at home; in a split group of different parts."""
        u = x / np.sqrt((x * x).sum(axis=1))[:, None]
        left, right = [], []

        def add(i, j, cos):
            ok = (cos >= self.cosine) & (home[i] | home[j]) & (~split[i] | (part[i] != part[j]))
            left.append(i[ok])
            right.append(j[ok])

        begin = np.cumsum(sizes) - sizes
        small = sizes <= 32
        rows = np.flatnonzero(np.repeat(small, sizes))
        i, j = _pairs_within(sizes[small])
        for s in range(0, len(i), _PAIRS):
            a, b = rows[i[s : s + _PAIRS]], rows[j[s : s + _PAIRS]]
            add(a, b, np.einsum("ij,ij->i", u[a], u[b]))
        for b0, m in zip(begin[~small].tolist(), sizes[~small].tolist()):
            for s in range(0, m, _ROWS):
                block = u[b0 + s : b0 + min(s + _ROWS, m)] @ u[b0 : b0 + m].T
                i, j = np.nonzero(block >= self.cosine)
                after = j > i + s
                i, j = i[after], j[after]
                add(b0 + s + i, b0 + j, block[i, j])
        return np.concatenate(left) if left else np.zeros(0, int), np.concatenate(right) if right else np.zeros(0, int)

    def first(self, i: np.ndarray, j: np.ndarray, x: np.ndarray, node: np.ndarray, home: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Of pairs that meet in a cell of ``table``, those that meet in no earlier table, nor in this one elsewhere first."""
        rows, at = np.unique(np.concatenate((i, j)), return_inverse=True)
        own, probed = (np.concatenate(c) for c in zip(*(cells(x[rows[s : s + _ROWS]], self.cosine, *self.shape) for s in range(0, len(rows), _ROWS))))
        a, b = at[: len(i)], at[len(i) :]
        out = np.zeros(len(i), bool)
        tables = np.arange(self.shape[0])
        for s in range(0, len(i), _PAIRS):
            p, q, t = a[s : s + _PAIRS], b[s : s + _PAIRS], table[i[s : s + _PAIRS]]
            same = own[p] == own[q]
            into_p = (probed[q] == own[p][:, :, None]).any(axis=2)  # q probes p's home
            into_q = (probed[p] == own[q][:, :, None]).any(axis=2)
            earlier = ((same | into_p | into_q) & (tables < t[:, None])).any(axis=1)
            k = np.arange(len(p))
            hp, hq = home[i[s : s + _PAIRS]], home[j[s : s + _PAIRS]]
            elsewhere = np.where(hp, into_q[k, t], into_p[k, t]) & ~(hp & hq)
            lower = np.where(hp, node[i[s : s + _PAIRS]] < node[j[s : s + _PAIRS]], node[j[s : s + _PAIRS]] < node[i[s : s + _PAIRS]])
            out[s : s + _PAIRS] = ~earlier & (~elsewhere | lower)
        return out

    def links(self, x, node, copies, table, home, part, split, sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes with links, the copies they link to, and of each a node of its component here."""
        i, j = self.linked(x, sizes, home, part, split)
        if len(i):
            new = self.first(i, j, x, node, home, table)
            i, j = i[new], j[new]
        if not len(i):
            return (np.zeros(0, np.int64),) * 3
        count = np.bincount(i, weights=copies[j], minlength=len(x)) + np.bincount(j, weights=copies[i], minlength=len(x))
        root = np.arange(len(x))
        while True:
            low = root.copy()
            np.minimum.at(low, i, root[j])
            np.minimum.at(low, j, root[i])
            low = low[low]
            if (low == root).all():
                break
            root = low
        rows = np.flatnonzero(count)
        return node[rows], count[rows].astype(np.int64), node[root[rows]]


def lattice_links(nodes: DataFrame, cosine: float, tables: int, blocks: int, probes: int, tile: int) -> DataFrame:
    """``node, links, root``, several rows a node, of ``node, x, copies``: links counted in copies; root is linked to the node, if by others."""
    shape = (tables, blocks, probes)

    def code(batches):
        settle()
        for batch in batches:
            ids, x = batch.column(0), batch.column(1)
            lengths = np.asarray(x.value_lengths())
            for d in np.unique(lengths):
                rows = np.flatnonzero(lengths == d)
                for s in range(0, len(rows), _ROWS):
                    some = rows[s : s + _ROWS]
                    own, probed = cells(_matrix(x.take(pa.array(some)), int(d)), cosine, *shape)
                    key = np.concatenate((own[:, :, None], probed), axis=2)
                    n = key.shape[1] * key.shape[2]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(key.reshape(-1)), pa.array(np.repeat(np.asarray(ids.take(pa.array(some))), n)),
                        pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int16), 1 + probes), len(some)), pa.int16()), pa.array(np.tile(np.arange(1 + probes) == 0, tables * len(some))),
                    ], names=["key", "node", "table", "home"])

    coded = materialize(nodes.select("node", "x").mapInArrow(code, "key bigint, node bigint, table smallint, home boolean"), "lattice")
    sizes = coded.groupBy("key").agg(F.count("*").alias("n"), F.max("home").alias("any_home")).where("n > 1 and any_home").select("key", F.ceil(F.col("n") / tile).cast("int").alias("parts"))
    placed = coded.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    placed = placed.select("key", "node", "table", "home", "part", other.alias("other"))
    meet = placed.join(nodes, "node").select("key", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "node", "table", "home", "part", "copies", "x")
    tiles = Tiles(cosine, *shape)

    def run(batches):
        settle()
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table):
            key, a, b, node, t, home, part, copies = (table.column(c).to_numpy() for c in range(8))
            x = table.column(8).combine_chunks()
            lengths = np.asarray(x.value_lengths())
            # cells of another length have other keys, save by chance: such groups are taken apart
            opens = np.ones(len(key), bool)
            opens[1:] = (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            group = np.cumsum(opens)
            for d in np.unique(lengths):
                rows = np.flatnonzero(lengths == d)
                _, counts = np.unique(group[rows], return_counts=True)
                got = tiles.links(_matrix(x.take(pa.array(rows)), int(d)), node[rows], copies[rows], t[rows].astype(int), home[rows].astype(bool), part[rows], (a != b)[rows], counts)
                if len(got[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()) for g in got], names=["node", "links", "root"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, a, b = (np.asarray(batch.column(c)) for c in range(3))
            same = (key == key[-1]) & (a == a[-1]) & (b == b[-1])
            cut = 0 if same.all() else batch.num_rows - int(np.argmin(same[::-1]))
            if held:  # does the open group end at once?
                last = [np.asarray(held[-1].column(c))[-1] for c in range(3)]
                if cut == 0 and [key[0], a[0], b[0]] != last:
                    yield from done(pa.Table.from_batches(held))
                    held = []
            if cut:
                yield from done(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from done(pa.Table.from_batches(held))

    return meet.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(run, "node bigint, links bigint, root bigint")


def lattice_components(embeddings: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row for each row of ``embeddings``.

    Two rows link if some table brings them together and their cosine in double precision is at least ``cosine``;
    ``n_links`` counts the rows linked with this one, equal vectors included. ``component_id`` is the smallest id
    reachable by links, ``kept`` whether it is the row's own. Rows that repeat an id are vectors each. A row without id
    links like others but names no component: where no row of a component has an id, its component is null and all
    are kept. Vectors null, empty, zero or with null or non-finite components link with nothing, and vectors of
    different lengths not with each other. More ``tables`` or ``probes`` find more pairs, more ``blocks`` compare fewer.
    """
    ship(embeddings.sparkSession)
    kind = next(f.dataType.elementType.simpleString() for f in embeddings.schema if f.name == vector)
    x = col(vector) if kind in ("float", "double") else col(vector).cast("array<double>")
    rows = embeddings.select(col(vec_id).alias("vec_id"), F.when(_usable(x), x).alias("x"))
    hashes = [F.when(F.col("x").isNotNull(), h).alias(n) for n, h in (("h1", F.xxhash64("x")), ("h2", F.xxhash64(F.lit(12), "x")))]
    rows = rows.select("vec_id", "x", *hashes)
    nodes = rows.where("x is not null").groupBy("h1", "h2").agg(F.first("x").alias("x"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = materialize(lattice_links(nodes.select("node", "x", "copies"), cosine, tables, blocks, probes, tile), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    component = connected_components(found.select("node", "root"), "node", "component")
    by_node = nodes.select("h1", "h2", "node", "copies", "least").join(links, "node", "left").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = by_node.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = by_node.join(least, "component").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", F.lit(True).alias("taking_part"))
    out = rows.select("vec_id", "h1", "h2").join(by_node, ["h1", "h2"], "left")
    out = out.withColumn("component_id", F.when(F.col("taking_part"), F.col("component_id")).otherwise(F.col("vec_id")))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "component_id", F.when(F.col("component_id").isNull(), True).otherwise(F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))).alias("kept"))
