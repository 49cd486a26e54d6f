"""Benchmark decontamination (operator 3): a prefix-filtered containment join.

Each benchmark window is a sequence of shingles that a document must hold in full. With full containment
the necessary prefix is one shingle, so a window is joined through its rarest one only, rarity being counted
over all documents. A match at position p of a shingle at offset o inside the window proposes the start
p - o; the length and positional bounds 0 <= p - o <= n_words - window length drop starts that can't fit, a
hash over the whole window drops nearly all others, and the words themselves decide.

A benchmark of a bounded number of windows is broadcast as one index, and documents are probed where they lie. A larger
one stays distributed: documents' shingles that pass a bit table of fixed size meet the windows' prefix shingles in a
shuffled join, and proposed windows go back to the documents by a hash of their texts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .bytewords import ALNUM, Words, words_of
from .tables import STEP_BYTES, col, materialize, settle, steps, texts_of

#: Windows in a broadcast index at most. Larger benchmarks are joined by shuffles.
INDEX_WINDOWS = 200_000
#: Bits of the table that says which shingles windows have, and of one row of it.
SIEVE, SIEVE_ROW = 1 << 25, 1 << 16


@dataclass
class WindowIndex:
    """Distinct windows, in ascending order of the hash of their prefix shingle."""

    words: list[bytes]  # joined by one space
    length: np.ndarray
    key: np.ndarray  # hash of the prefix shingle
    offset: np.ndarray
    width: np.ndarray  # words in the prefix shingle
    whole: np.ndarray  # hash of all words
    items: list[list[str]]
    unnamed: list[bool]  # an item without id has the window


def _window_hash(w: Words, at: np.ndarray, length: int) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for j in range(length):
        h = h * np.uint64(0xA24BAED4963EE407) + w.hash[at + j]
    return h


def _joined(w: Words, at: int, length: int) -> bytes:
    return b" ".join(w.data[w.start[i] : w.end[i]].tobytes() for i in range(at, at + length))


def windows(benchmark: DataFrame, *, item_id: str = "item_id", text: str = "text", words: int = 13) -> DataFrame:
    """``(window binary, n_words int, items array<string>, unnamed boolean)``: the distinct windows of all items.

    ``unnamed``: an item without id has the window. A window is ``words`` consecutive words, or the whole item if it has fewer; null or wordless items have none.
    """
    source = benchmark.select(col(item_id).cast("string").alias("item_id"), col(text).cast("string").alias("text")).where("text is not null")
    schema = pa.schema([("item_id", pa.string()), ("window", pa.binary()), ("n_words", pa.int32())])

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in steps(np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]), STEP_BYTES // 16):
                w = words_of(texts.slice(a, b - a), ALNUM)
                ids, found, lengths = [], [], []
                for d in range(b - a):
                    first, n = w.first[d], w.first[d + 1] - w.first[d]
                    size = min(words, n)
                    seen = {_joined(w, p, size) for p in range(first, first + n - size + 1)} if n else set()
                    found += seen
                    ids += [batch.column(0)[a + d].as_py()] * len(seen)
                    lengths += [size] * len(seen)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.binary()), pa.array(lengths, pa.int32())], schema=schema)

    rows = source.mapInArrow(run, "item_id string, window binary, n_words int")
    return rows.groupBy("window", "n_words").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max(F.col("item_id").isNull()).alias("unnamed"))


def _shingles(index_words: list[bytes], width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window, the hashes of its shingles in order (of all its words if it has fewer), and all word hashes."""
    out = []
    for a, b in steps([len(x) for x in index_words]):
        w = words_of(pa.array([x.decode("utf-8") for x in index_words[a:b]], pa.string()), ALNUM)
        for d in range(b - a):
            own = Words(w.data, w.start[w.first[d] : w.first[d + 1]], w.end, np.zeros(w.first[d + 1] - w.first[d], int), w.first, w.hash[w.first[d] : w.first[d + 1]])
            out.append((own.shingles(min(width, len(own.hash)))[1], own.hash))
    return out


def _count_shingles(documents: DataFrame, text: str, keys: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each of the given shingles occurs in all documents. keys: sorted hashes by shingle width."""
    shared = documents.sparkSession.sparkContext.broadcast({k: (v, _sieve(v)) for k, v in keys.items()})

    def run(batches):
        total = {k: np.zeros(len(v[0]), np.int64) for k, v in shared.value.items()}
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in steps(np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1])):
                w = words_of(texts.slice(a, b - a), ALNUM)
                for k, (v, sieve) in shared.value.items():
                    _, h = w.shingles(k)
                    np.add.at(total[k], _lookup(h, v, sieve)[1], 1)
        for k, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["width", "at", "n"])

    rows = documents.select(col(text).cast("string").alias("t")).where("t is not null").mapInArrow(run, "width int, at bigint, n bigint").groupBy("width", "at").agg(F.sum("n").alias("n"))
    out = {k: np.zeros(len(v), np.int64) for k, v in keys.items()}
    got = rows.toPandas()
    for k in out:
        mine = got[got["width"] == k]
        out[k][mine["at"].to_numpy(np.int64)] = mine["n"].to_numpy(np.int64)
    return out


def _sieve(keys: np.ndarray) -> np.ndarray:
    """A table by the top 20 bits: False where no key has them."""
    s = np.zeros(1 << 20, bool)
    s[(keys >> np.uint64(44)).astype(np.int64)] = True
    return s


def _lookup(h: np.ndarray, keys: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``h`` of hashes that are in ``keys`` (sorted), and where in ``keys`` they are."""
    at = np.flatnonzero(sieve[(h >> np.uint64(44)).astype(np.int64)])
    if not len(at) or not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    j = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
    ok = keys[j] == h[at]
    return at[ok], j[ok]


def _index(rows: list, documents: DataFrame, text: str, width: int) -> WindowIndex:
    words = [bytes(r["window"]) for r in rows]
    shingles = _shingles(words, width)
    by_width: dict[int, set[int]] = {}
    for s, own in shingles:
        by_width.setdefault(min(width, len(own)), set()).update(s.tolist())
    keys = {k: np.array(sorted(v), np.uint64) for k, v in by_width.items()}
    counts = _count_shingles(documents, text, keys)
    key, offset, widths, whole = [], [], [], []
    for s, own in shingles:
        k = min(width, len(own))
        n = counts[k][np.searchsorted(keys[k], s)]
        o = int(np.lexsort((s, n))[0])  # rarest, ties by hash
        key.append(s[o])
        offset.append(o)
        widths.append(k)
        w = Words(np.zeros(0, np.uint8), own, own, own, own, own)
        whole.append(_window_hash(w, np.zeros(1, np.int64), len(own))[0])
    order = np.argsort(np.array(key, np.uint64), kind="stable")
    pick = lambda a, t: np.array(a, t)[order] if len(order) else np.zeros(0, t)
    return WindowIndex([words[i] for i in order], pick([r["n_words"] for r in rows], np.int64), pick(key, np.uint64), pick(offset, np.int64), pick(widths, np.int64), pick(whole, np.uint64), [list(rows[i]["items"]) for i in order], [bool(rows[i]["unnamed"]) for i in order])


def _occurrences(w: Words, index: WindowIndex, sieves: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All (first word, window) pairs where a window occurs inside a text."""
    starts, found = [], []
    for k, sieve in sieves.items():
        mine = np.flatnonzero(index.width == k)
        keys = index.key[mine]
        at, h = w.shingles(k)
        hit = np.flatnonzero(sieve[(h >> np.uint64(44)).astype(np.int64)])
        if not len(hit):
            continue
        low, high = np.searchsorted(keys, h[hit], "left"), np.searchsorted(keys, h[hit], "right")
        many = high - low
        p = np.repeat(at[hit], many)
        j = np.repeat(low, many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
        j = mine[j]
        doc, s = w.doc[p], p - index.offset[j]
        ok = (s >= w.first[doc]) & (s + index.length[j] <= w.first[doc + 1])  # position and length
        s, j = s[ok], j[ok]
        for length in np.unique(index.length[j]):
            own = np.flatnonzero(index.length[j] == length)
            own = own[_window_hash(w, s[own], int(length)) == index.whole[j[own]]]
            own = [i for i in own if _joined(w, s[i], int(length)) == index.words[j[i]]]
            starts.append(s[own])
            found.append(j[own])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *found])


def _merged(starts: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    s, e = [], []
    for a, b in sorted(zip(starts, ends)):
        if s and a <= e[-1]:
            e[-1] = max(e[-1], b)
        else:
            s.append(a)
            e.append(b)
    return s, e


def _probe(documents: DataFrame, index: WindowIndex) -> DataFrame:
    """Adds to ``hits`` (words, spans and items so far) what the windows of one index find. Columns: row, text, hits."""
    shared = documents.sparkSession.sparkContext.broadcast((index, {int(k): _sieve(index.key[index.width == k]) for k in np.unique(index.width)}))
    schema = T.StructType(documents.schema.fields)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        settle()
        own, sieves = shared.value
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in steps(np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1])):
                w = words_of(texts.slice(a, b - a), ALNUM)
                s, j = _occurrences(w, own, sieves)
                doc = w.doc[s]
                had = batch.column(2).slice(a, b - a).to_pylist()
                out = []
                order = np.argsort(doc, kind="stable")
                bounds = np.searchsorted(doc[order], np.arange(b - a + 1))
                for d, before in enumerate(had):
                    here = order[bounds[d] : bounds[d + 1]]
                    start, end, items, unnamed = before["starts"], before["ends"], before["items"], before["unnamed"]
                    if len(here):
                        at = s[here] - w.first[d]
                        start, end = _merged(start + at.tolist(), end + (at + own.length[j[here]]).tolist())
                        items = sorted({*items, *(i for x in set(j[here].tolist()) for i in own.items[x])})
                        unnamed = unnamed or any(own.unnamed[x] for x in set(j[here].tolist()))
                    out.append({"n_words": int(w.first[d + 1] - w.first[d]), "starts": start, "ends": end, "items": items, "unnamed": unnamed})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(out, target.field(2).type)], schema=target)

    return documents.mapInArrow(run, schema)


def _texts_lengths(texts: pa.Array) -> np.ndarray:
    return np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1])


def _spread(found: DataFrame, width: int) -> DataFrame:
    """``wkey, width, hash, offset`` of every shingle of every window."""

    def run(batches):
        for batch in batches:
            words = batch.column(1).to_pylist()
            for a, b in steps([len(x) for x in words], STEP_BYTES // 16):
                got = _shingles(words[a:b], width)
                counts = [len(h) for h, _ in got]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a).take(pa.array(np.repeat(np.arange(b - a), counts))), pa.array(np.repeat([min(width, len(own)) for _, own in got], counts), pa.int32()),
                    pa.array(np.concatenate([h for h, _ in got]).view(np.int64)), pa.array(np.concatenate([np.arange(n) for n in counts]), pa.int32()),
                ], names=["wkey", "width", "hash", "offset"])

    return found.select("wkey", "window").mapInArrow(run, "wkey string, width int, hash bigint, offset int")


def _bit_table(keys: DataFrame) -> np.ndarray:
    """Which values the top bits of the keys' hashes have, as packed bits: SIEVE bits, whatever the number of keys."""
    bits, row = SIEVE.bit_length() - 1, SIEVE_ROW.bit_length() - 1

    def pack(table: pa.Table) -> pa.Table:
        flags = np.zeros(SIEVE_ROW, bool)
        flags[table.column("slot").to_numpy() & (SIEVE_ROW - 1)] = True
        return pa.table({"part": table.column("part").slice(0, 1), "v": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    slots = keys.select(F.shiftrightunsigned("hash", 64 - bits).alias("slot")).distinct().withColumn("part", F.shiftright("slot", row).cast("int"))
    out = np.zeros(SIEVE // 8, np.uint8)
    for r in slots.groupBy("part").applyInArrow(pack, "part int, v binary").collect():  # at most SIEVE / SIEVE_ROW rows
        out[r["part"] * (SIEVE_ROW // 8) : (r["part"] + 1) * (SIEVE_ROW // 8)] = np.frombuffer(r["v"], np.uint8)
    return out


def _document_shingles(docs: DataFrame, keys: DataFrame, *, places: bool) -> DataFrame:
    """Shingles of texts that the keys' bit table lets pass: how often (``width, hash, n``), or where (``tkey, n_words, width, hash, pos``)."""
    widths = sorted(r["width"] for r in keys.select("width").distinct().collect())  # 1 to the shingle's width
    shared = docs.sparkSession.sparkContext.broadcast(_bit_table(keys))
    shift = np.uint64(64 - (SIEVE.bit_length() - 1))

    def run(batches):
        table = shared.value
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in steps(_texts_lengths(texts)):
                w = words_of(texts.slice(a, b - a), ALNUM)
                for k in widths:
                    at, h = w.shingles(k)
                    slot = h >> shift
                    ok = (table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0
                    at, h = at[ok], h[ok]
                    if not places:
                        h, n = np.unique(h, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k), pa.int32()), pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["width", "hash", "n"])
                        continue
                    doc = w.doc[at]
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(w.first[doc + 1] - w.first[doc], pa.int64()), pa.array(np.full(len(h), k), pa.int32()), pa.array(h.view(np.int64)), pa.array(at - w.first[doc], pa.int64()),
                    ], names=["tkey", "n_words", "width", "hash", "pos"])

    if places:
        return docs.select("tkey", "text").mapInArrow(run, "tkey string, n_words bigint, width int, hash bigint, pos bigint")
    return docs.select("tkey", "text").mapInArrow(run, "width int, hash bigint, n bigint").groupBy("width", "hash").agg(F.sum("n").alias("n"))


def _join(docs: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """``row, text, hits`` of ``docs(row, text)`` as :func:`_probe` makes them, the windows never leaving Spark."""
    found = materialize(found.withColumn("wkey", F.md5("window")), "windows")
    spread = materialize(_spread(found, width), "shingles")
    keyed = docs.withColumn("tkey", F.md5(F.col("text").cast("binary")))
    texts = keyed.where("text is not null").select("tkey", "text")
    counts = _document_shingles(texts, spread, places=False)
    rarest = F.min_by(F.struct("width", "hash", "offset"), F.struct(F.coalesce("n", F.lit(0)), "hash", "offset"))
    prefix = spread.join(counts, ["width", "hash"], "left").groupBy("wkey").agg(rarest.alias("p")).select("wkey", "p.width", "p.hash", "p.offset")
    prefix = materialize(prefix.join(found.select("wkey", F.col("n_words").alias("length")), "wkey"), "prefixes")
    start = F.col("pos") - F.col("offset")
    hits = _document_shingles(texts, prefix, places=True).join(prefix, ["width", "hash"]).where((start >= 0) & (start + F.col("length") <= F.col("n_words")))
    proposed = hits.select("tkey", start.cast("int").alias("start"), "wkey").distinct().join(found, "wkey")
    proposed = proposed.groupBy("tkey").agg(F.collect_list(F.struct("start", "window", "n_words", "items", "unnamed")).alias("proposed"))  # of one text
    joined = keyed.join(proposed, "tkey", "left").select("row", "text", "proposed")
    fields = docs.schema.fields + T.StructType.fromDDL(HITS).fields
    schema = T.StructType(fields)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in steps(_texts_lengths(texts)):
                w = words_of(texts.slice(a, b - a), ALNUM)
                out = []
                for d in range(b - a):
                    first, offers = int(w.first[d]), batch.column(2)[a + d].as_py() or []
                    true = [o for o in offers if _joined(w, first + o["start"], o["n_words"]) == o["window"]]
                    start, end = _merged([o["start"] for o in true], [o["start"] + o["n_words"] for o in true])
                    out.append({"n_words": int(w.first[d + 1]) - first, "starts": start, "ends": end, "items": sorted({i for o in true for i in o["items"]}), "unnamed": any(o["unnamed"] for o in true)})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(out, target.field(2).type)], schema=target)

    return joined.mapInArrow(run, schema)


#: What is found in a document.
HITS = "hits struct<n_words:int,starts:array<int>,ends:array<int>,items:array<string>,unnamed:boolean>"


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ("doc_id",), words: int = 13, shingle: int = 3, hit_share: int = 20, index_windows: int = INDEX_WINDOWS) -> DataFrame:
    """``row`` (struct of the kept columns), ``n_words``, ``n_hit``, ``items``, ``unnamed``, ``starts``, ``ends``, ``contaminated`` for every document.

    ``starts`` and ``ends`` (exclusive) are merged spans of hit words, counted from 0; ``items`` the ids, as strings in
    order, of items with a window in the document; ``unnamed``: an item without id has one; contaminated: ``n_hit > 0 and hit_share * n_hit >= n_words``.
    Null texts have no words and no hits. Items without id hit as others do and give no name; those without words are ignored; an empty benchmark hits nothing.
    Repeated documents and null ids give a row each; equal windows of several items count for each of them.
    Up to ``index_windows`` windows are broadcast; more are joined by shuffles, with the same result.
    Documents of any length and empty tables are handled alike; extra columns are kept as asked or ignored.
    """
    ship(documents.sparkSession)
    found = windows(benchmark, item_id=item_id, text=item_text, words=words)
    docs = documents.select(F.struct(*[col(c) for c in keep]).alias("row"), col(text).cast("string").alias("text"))
    if found.limit(index_windows + 1).count() <= index_windows:
        nothing = F.expr("named_struct('n_words', 0, 'starts', array(), 'ends', array(), 'items', array(), 'unnamed', false)")
        rows = sorted(found.collect(), key=lambda r: bytes(r["window"]))
        out = _probe(docs.withColumn("hits", nothing.cast(T.StructType.fromDDL(HITS)["hits"].dataType)), _index(rows, documents, text, shingle))
    else:
        out = _join(docs, found, shingle)
    n_hit = F.aggregate(F.zip_with("hits.ends", "hits.starts", lambda e, s: (e - s).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.select("row", F.col("hits.n_words").cast("bigint").alias("n_words"), n_hit.alias("n_hit"), F.col("hits.items").alias("items"), F.col("hits.unnamed").alias("unnamed"), F.col("hits.starts").alias("starts"), F.col("hits.ends").alias("ends")).withColumn("contaminated", (F.col("n_hit") > 0) & (hit_share * F.col("n_hit") >= F.col("n_words")))


def digest(items: list[str]) -> str:
    """The sha-256 of comma-joined item ids, as the query's ``items_sha256`` gives it."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()
