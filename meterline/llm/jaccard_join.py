"""N-gram Jaccard join (operator 4): documents linked by near-equal sets of word shingles, and their components.

Plan, exact at every step:

1. Every document becomes the sorted array of its distinct shingle hashes (64 bits). Equal arrays are one *set*.
2. A set lists its prefix: under one total order, rarest first, two sets of similarity t share one of their
   first ``n - ceil(t * n) + 1`` shingles. Rarity comes from a count sketch of fixed size over all documents; any
   total order is exact, the sketch only keeps common shingles out of prefixes.
3. Sets with a common prefix shingle form a group, banded by size: only sizes within ratio t are compared. Hashed
   bitmaps bound the overlap from above by bit counts. Inside a tile a search by frontier keeps one edge per newly
   reached set, so a tile gives fewer edges than it has sets, however alike they are.
4. Components of these edges are candidate clusters: two linked sets are always in one cluster. A cluster is a group
   again, now with whole arrays: bitmaps bound, and sorted-array intersection decides.

A group of many sets is cut into tiles by size band and hash. Each tile is searched alone, then a few sets of each tile
among themselves, which joins families of near copies across tiles. Only sets outside a group's largest component so
far meet all tiles of neighbouring bands. So a family that holds together costs its size, and none of its links is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .bytewords import NOT_SPACE, mix, words_of
from .components import connected_components
from .tables import by_group, col, map_texts, materialize, settle, steps, sum_vectors, texts_of

#: Counters of the rarity sketch.
SKETCH = 1 << 20
#: Sets in one tile at most; larger tiles are split and their parts paired.
TILE = 2048
#: Shingles in one tile at most, over all its sets.
TILE_SHINGLES = 4_000_000


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: runs of k words; the whole sequence if it has fewer."""
    w = words_of(texts, NOT_SPACE)
    at, h = w.shingles(k)
    bounds = np.searchsorted(at, w.first)
    out = []
    for d in range(len(w.first) - 1):
        n = w.first[d + 1] - w.first[d]
        if n >= k:
            out.append(np.unique(h[bounds[d] : bounds[d + 1]]))
        elif n:
            own = np.uint64(n)
            for x in w.hash[w.first[d] : w.first[d + 1]]:
                own = mix(np.array([own], np.uint64))[0] ^ x
            out.append(mix(np.array([own], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _least_overlap(a, b, percent: int):
    """Smallest intersection of sets of sizes a and b with 100 * intersection >= percent * union."""
    return -((-percent * (a + b)) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -((-percent * n) // 100) + 1


def bitmap(array: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap of the hashes, ``bits`` a power of two of 64 at least."""
    out = np.zeros(bits // 64, np.uint64)
    slot = array & np.uint64(bits - 1)
    np.bitwise_or.at(out, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
    return out


def _bits(n: int) -> int:
    return 1 << max(6, int(2 * n - 1).bit_length())


def _fold(m: np.ndarray, words: int) -> np.ndarray:
    while len(m) > words:
        m = m[: len(m) // 2] | m[len(m) // 2 :]
    return m


def overlap_bound(maps: np.ndarray, sizes: np.ndarray, one: np.ndarray, size: int) -> np.ndarray:
    """From above, the intersection of each set with one other: each bit that only one side has is a missing element."""
    only_many = np.bitwise_count(maps & ~one).sum(axis=1, dtype=np.int64)
    only_one = np.bitwise_count(one & ~maps).sum(axis=1, dtype=np.int64)
    return np.minimum(sizes - only_many, size - only_one)


def _rarity(documents: DataFrame, text: str, k: int) -> np.ndarray:
    """Counts of all shingles of all documents in a sketch of fixed size, as orders of magnitude."""
    width = 1024

    def run(batches):
        settle()
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in steps(np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1])):
                _, h = words_of(texts.slice(a, b - a), NOT_SPACE).shingles(k)
                if len(h):
                    total += np.bincount((h >> np.uint64(44)).astype(np.int64), minlength=SKETCH)
        part = total.reshape(-1, width)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(part)), pa.int32()), pa.array([p.tobytes() if p.any() else None for p in part], pa.binary())], names=["part", "v"])

    parts = documents.select(col(text).cast("string").alias("t")).where("t is not null").mapInArrow(run, "part int, v binary").where("v is not null")
    out = np.zeros(SKETCH, np.int64)
    for r in sum_vectors(parts, "int64").collect():
        out[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["v"], np.int64)
    return np.minimum(255, np.log2(np.maximum(out, 1)) * 4).astype(np.uint8)


def _profiles(documents: DataFrame, keep: tuple[str, ...], text: str, k: int, percent: int) -> DataFrame:
    """``row, n, set_id, prefix, bits`` of every document; set_id, prefix and bits null for empty sets."""
    level = documents.sparkSession.sparkContext.broadcast(_rarity(documents, text, k))

    def fn(texts: pa.Array) -> dict:
        n, ids, prefix, bits = [], [], [], []
        for s in shingle_sets(texts, k):
            n.append(len(s))
            if not len(s):
                ids.append(None), prefix.append(None), bits.append(None)
                continue
            ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            order = np.lexsort((s, level.value[(s >> np.uint64(44)).astype(np.int64)]))
            prefix.append(s[order[: prefix_length(len(s), percent)]].tobytes())
            bits.append(bitmap(s, _bits(len(s))).tobytes())
        return {"n": n, "set_id": ids, "prefix": prefix, "bits": bits}

    return map_texts(documents, text, keep, fn, "n bigint, set_id binary, prefix binary, bits binary")


def _posted(profiles: DataFrame) -> DataFrame:
    """``token, set_id``: each set under each shingle of its prefix; repeats inside a batch go at once."""
    schema = pa.schema([("token", pa.int64()), ("set_id", pa.binary())])

    def run(batches):
        for batch in batches:
            seen: dict[bytes, bytes] = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            some = list(seen.items())
            for a, b in steps([len(p) for _, p in some], 1 << 20):
                part = some[a:b]
                counts = [len(p) // 8 for _, p in part]
                at = pa.array(np.repeat(np.arange(len(part)), counts))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(p for _, p in part), np.int64)), pa.array([i for i, _ in part], pa.binary()).take(at)], schema=schema)

    return profiles.select("set_id", "prefix").where("set_id is not null").mapInArrow(run, "token bigint, set_id binary")


def _tiles(posted: DataFrame) -> DataFrame:
    """``tile, part, set_id``: groups of two sets or more with a common prefix shingle, equal groups once.

    One pass over rows sorted by shingle. A group beyond TILE is cut into parts in the order of the rows; the
    parts are paired later, so no task holds more than TILE rows of a group.
    """
    schema = pa.schema([("tile", pa.int64()), ("part", pa.int32()), ("set_id", pa.binary())])

    def run(batches):
        token, held, part, out = None, [], 0, []
        recent: set[int] = set()

        def close(last: bool):
            nonlocal held, part
            if part or not last or len(held) > 1:
                if part or not last:
                    name = token
                else:
                    name = int.from_bytes(hashlib.blake2b(b"".join(held), digest_size=8).digest(), "little", signed=True)
                if part or not last or name not in recent:
                    out.extend((name, part, x) for x in held)
                    recent.add(name)
                    if len(recent) > 100_000:
                        recent.clear()
            part = 0 if last else part + 1
            held = []

        for batch in batches:
            tokens, ids = batch.column(0).to_numpy(), batch.column(1)
            edge = np.flatnonzero(np.diff(tokens)) + 1
            starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(tokens)]])
            if not len(tokens):
                continue
            worth = ends - starts > 1
            worth[[0, -1]] = True  # those may go on in another batch
            for i in np.flatnonzero(worth):
                t = tokens[starts[i]]
                if t != token:
                    if len(held) > 1 or part:
                        close(True)
                    token, held, part = t, [], 0
                for x in ids[starts[i] : ends[i]].to_pylist():
                    if not held or x != held[-1]:
                        held.append(x)
                        if len(held) == TILE:
                            close(False)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out = []
        if len(held) > 1 or part:
            close(True)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return posted.repartition("token").sortWithinPartitions("token", "set_id").mapInArrow(run, "tile bigint, part int, set_id binary").distinct()


def _frontier(sizes: np.ndarray, near) -> list[tuple[int, int]]:
    """A star for each component, from its first set to the others; ``near(i, those)`` says which of the unvisited ``those`` are adjacent to i."""
    left = np.arange(len(sizes))
    edges, queue, root = [], [], 0
    while len(left):
        if not queue:
            root = int(left[0])
            queue.append(root)
            left = left[1:]
        i = queue.pop()
        if len(left):
            ok = near(i, left)
            for j in left[ok]:
                edges.append((root, int(j)))
            queue.extend(left[ok].tolist())
            left = left[~ok]
    return edges


def _banded(sizes: np.ndarray, size: int, percent: int) -> np.ndarray:
    return (100 * np.minimum(sizes, size) >= percent * np.maximum(sizes, size)) & (sizes > 0)


def _by_bitmaps(sets: list[tuple[int, bytes]], percent: int):
    """``near`` for :func:`_frontier`, by bitmap bound. sets: size and bitmap."""
    n, raw = np.array([x[0] for x in sets], np.int64), [np.frombuffer(x[1], np.uint64) for x in sets]
    folded: dict[int, np.ndarray] = {}

    def near(i: int, left: np.ndarray) -> np.ndarray:
        ok = _banded(n[left], n[i], percent)
        if ok.any():
            words = min(len(raw[i]), min(len(raw[x]) for x in left[ok]))
            if words not in folded:
                folded[words] = np.stack([_fold(r, words) if len(r) >= words else np.zeros(words, np.uint64) for r in raw])
            some = left[ok]
            ok[ok] = overlap_bound(folded[words][some], n[some], folded[words][i], int(n[i])) >= _least_overlap(n[some], n[i], percent)
        return ok

    return n, near


def _by_arrays(sets: list[tuple[int, bytes]], percent: int):
    """``near`` by bitmap bound, then sorted-array intersection. sets: size and hashes."""
    whole = [np.frombuffer(x[1], np.uint64) for x in sets]
    n = np.array([len(x) for x in whole], np.int64)
    words = max(1, _bits(int(np.median(n))) // 64) if len(n) else 1
    maps = np.stack([bitmap(x, 64 * words) for x in whole])

    def near(i: int, left: np.ndarray) -> np.ndarray:
        ok = _banded(n[left], n[i], percent)
        some = left[ok]
        if len(some):
            least = _least_overlap(n[some], n[i], percent)
            good = overlap_bound(maps[some], n[some], maps[i], int(n[i])) >= least
            for x in np.flatnonzero(good):
                good[x] = _common(whole[some[x]], whole[i]) >= least[x]
            ok[ok] = good
        return ok

    return n, near


def _edges(rows: DataFrame, keys: list[str], by, percent: int) -> DataFrame:
    """Stars of the components of each cell. Columns of rows: keys, set_id, n, data."""

    def link(rows: list[tuple]) -> list[tuple]:
        ids = [r[0] for r in rows]
        if len(ids) == 2 and by is _by_bitmaps:  # most cells
            return [(ids[0], ids[1])] if _pair_bound([r[2] for r in rows], np.array([r[1] for r in rows], np.int64), percent) else []
        n, near = by([r[1:] for r in rows], percent)
        return [(ids[x], ids[y]) for x, y in _frontier(n, near)]

    return by_group(rows, keys, ["set_id", "n", "data"], link, "a binary, b binary")


def _between(rows: DataFrame, keys: list[str], by, percent: int) -> DataFrame:
    """Edges between the two sides of each cell, one from a set of side 1 to each component of side 0 that it reaches.

    Columns of rows: keys, side, set_id, n, data, component.
    """

    def link(rows: list[tuple]) -> list[tuple]:
        n, near = by([r[2:4] for r in rows], percent)
        side, ids, part = np.array([r[0] for r in rows]), [r[1] for r in rows], [r[4] for r in rows]
        number = {p: i for i, p in enumerate(dict.fromkeys(part))}
        of = np.array([number[p] for p in part])
        those, out = np.flatnonzero(side == 0), []
        for i in np.flatnonzero(side == 1):
            left = those[of[those] != of[i]]
            hits = left[near(int(i), left)] if len(left) else left
            out += [(ids[i], ids[j]) for j in hits[np.unique(of[hits], return_index=True)[1]]]
        return out

    return by_group(rows, keys, ["side", "set_id", "n", "data", "component"], link, "a binary, b binary")


def _linked(groups: DataFrame, payload: DataFrame, by, percent: int, tag: str) -> DataFrame:
    """Edges that connect, inside each group, all sets that ``by`` finds adjacent. groups: g, set_id; payload: set_id, n, band, data."""
    known = payload.select("set_id", "n", "band")
    groups = groups.join(known, "set_id")
    bands = groups.groupBy("g", "band").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    whole = bands.groupBy("g").agg(((F.sum("sets") <= TILE) & (F.sum("shingles") <= TILE_SHINGLES)).alias("small"))
    cuts = bands.join(whole.where("not small"), "g").select("g", "band", F.greatest(F.ceil(F.col("sets") / TILE), F.ceil(F.col("shingles") / TILE_SHINGLES)).cast("bigint").alias("cuts"))
    cuts = materialize(cuts, "cuts")
    step = 1 << 20
    tile = lambda n: F.col("band") * step + F.pmod(F.xxhash64("set_id"), F.col(n))
    with_data = lambda rows: rows.join(payload.select("set_id", "n", "data"), "set_id")
    if cuts.isEmpty():
        return materialize(_edges(with_data(groups.select("g", "set_id")), ["g"], by, percent).distinct(), tag)
    dealt = groups.select("g", "set_id", "band").join(cuts, ["g", "band"], "left").select("g", "set_id", "band", F.coalesce(tile("cuts"), F.lit(-1).cast("bigint")).alias("t"))
    dealt = materialize(dealt, "dealt")
    links = materialize(_edges(with_data(dealt.select("g", "t", "set_id")), ["g", "t"], by, percent).distinct(), tag)
    large = dealt.where("t >= 0")
    # a few sets of each tile, one of each of its largest components, among themselves
    part = connected_components(links, "set_id", "component")
    own = large.join(part, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    roots = own.groupBy("g", "t", "component").agg(F.count("*").alias("sets"), F.min("set_id").alias("set_id"))
    tiles = cuts.groupBy("g").agg(F.sum("cuts").alias("tiles"))
    first = F.row_number().over(Window.partitionBy("g", "t").orderBy(F.desc("sets"), "set_id"))
    few = roots.withColumn("r", first).join(tiles, "g").where(F.col("r") <= F.greatest(F.floor(TILE / F.col("tiles")), F.lit(1)))
    few = few.select("g", F.pmod(F.xxhash64("t"), F.ceil(F.col("tiles") / TILE)).alias("u"), "set_id")
    links = materialize(links.unionByName(_edges(with_data(few), ["g", "u"], by, percent)).distinct(), tag)
    # whatever is not in a group's largest component meets all
    part = connected_components(links, "set_id", "component")
    own = materialize(large.join(part, "set_id", "left").withColumn("component", F.coalesce("component", "set_id")), "parts")
    most = own.groupBy("g", "component").agg(F.count("*").alias("sets")).groupBy("g").agg(F.max_by("component", F.struct("sets", "component")).alias("most"))
    others = own.join(most, "g").where("component != most").drop("most")
    blocks = others.groupBy("g", "band").agg(F.ceil(F.count("*") / TILE).cast("bigint").alias("blocks"))
    others = others.join(blocks, ["g", "band"]).withColumn("o", tile("blocks"))
    held = others.select("g", "band", "o").distinct()
    near = held.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    cells = materialize(own.select("g", "band", "t").distinct().join(near, ["g", "band"]).select("g", "t", "o"), "cells")
    sides = own.select("g", "t", F.lit(0).alias("side"), "set_id", "component").join(cells, ["g", "t"]).select("g", "t", "o", "side", "set_id", "component")
    sides = sides.unionByName(others.select("g", "o", F.lit(1).alias("side"), "set_id", "component").join(cells, ["g", "o"]).select("g", "t", "o", "side", "set_id", "component"))
    return materialize(links.unionByName(_between(with_data(sides), ["g", "t", "o"], by, percent)).distinct(), tag)


def _pair_bound(bits: list[bytes], n: np.ndarray, percent: int) -> bool:
    if not _banded(n[:1], int(n[1]), percent)[0]:
        return False
    a, b = (np.frombuffer(x, np.uint64) for x in bits)
    words = min(len(a), len(b))
    a, b = _fold(a, words), _fold(b, words)
    return bool(overlap_bound(a[None], n[:1], b, int(n[1]))[0] >= _least_overlap(int(n[0]), int(n[1]), percent))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def jaccard_components(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every document.

    Two documents link when 100 * intersection >= percent * union of their sets of ``k``-word shingles (white-space
    words, A-Z lowered; the whole sequence where a text has fewer words). component_id: the smallest doc_id
    reachable by links, the document's own included. Null texts and texts without words have an empty set, link
    with nothing and are their own component. Repeated rows link with each other and each give a row. A null id
    is never a component_id: such rows join the component of a row with equal set and an id, else they link with
    nothing and have a null component_id. Other columns are ignored.
    """
    ship(documents.sparkSession)
    profiles = materialize(_profiles(documents.select(col(doc_id).alias("doc_id"), col(text).alias("text")), ("doc_id",), "text", k, percent), "profiles")
    groups = materialize(_tiles(_posted(profiles)).select(F.col("tile").alias("g"), "set_id").distinct(), "groups")
    wanted = groups.select("set_id").distinct()
    sets = profiles.where("set_id is not null").select("set_id", "n", "bits", F.col("row.doc_id").alias("doc_id"))
    some = sets.join(wanted, "set_id", "left_semi").groupBy("set_id").agg(F.max("n").alias("n"), F.max("bits").alias("data"), F.min("doc_id").alias("doc_id"))
    some = materialize(some.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / float(np.log(100.0 / percent)) + 1e-9).cast("bigint")), "sets")
    candidates = _linked(groups, some, _by_bitmaps, percent, "candidates")
    clusters = materialize(connected_components(candidates, "set_id", "cluster"), "clusters")
    texts = documents.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text"))
    wanted_ids = clusters.join(some.select("set_id", "doc_id"), "set_id").select("doc_id").distinct().hint("shuffle_hash")
    arrays = map_texts(texts.join(wanted_ids, "doc_id", "left_semi"), "text", ("doc_id",), _arrays(k), "set_id binary, hashes binary")
    arrays = arrays.join(clusters.select("set_id"), "set_id", "left_semi").groupBy("set_id").agg(F.max("hashes").alias("data"))
    arrays = materialize(arrays.join(some.select("set_id", "n", "band"), "set_id"), "arrays")
    links = _linked(clusters.select(F.xxhash64("cluster").alias("g"), "set_id"), arrays, _by_arrays, percent, "links")
    linked = connected_components(links, "set_id", "part")
    owner = profiles.where("set_id is not null").groupBy("set_id").agg(F.min("row.doc_id").alias("least"))
    part = owner.join(linked, "set_id").groupBy("part").agg(F.min("least").alias("part_least"))
    named = owner.join(linked, "set_id", "left").join(part, "part", "left").select("set_id", F.coalesce("part_least", "least").alias("component_id"))
    rows = profiles.select(F.col("row.doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), "set_id")
    alone = rows.where("set_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.where("set_id is not null").join(named, "set_id").select("doc_id", "n_shingles", "component_id").unionByName(alone)


def _arrays(k: int):
    def fn(texts: pa.Array) -> dict:
        sets = [s if len(s) else None for s in shingle_sets(texts, k)]
        return {"set_id": [None if s is None else hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], "hashes": [None if s is None else s.tobytes() for s in sets]}

    return fn
