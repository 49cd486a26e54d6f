"""Token-ID output (operator 5): whole texts as ids in files of range-coded blocks, in ascending id order.

The files are a Parquet dataset that Spark writes and commits, so a lost task leaves nothing behind. A row is a
group: consecutive documents, one shared frequency table, and the independent blocks of :mod:`.rans`. ``shard`` and
``number`` put groups in order; the first token of a document follows from the sums of the groups before it.
"""

from __future__ import annotations

import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import new_path
from . import rans
from .tables import CACHES, col, settle, steps, texts_of

#: Ids in a group: it ends with the document that reaches this.
GROUP = 1 << 19
#: Pieces that a worker remembers at most; beyond, those seen least often are forgotten.
PIECES = 350_000
#: Bytes of text that are cut into pieces at once.
STEP = 2 << 20
_loaded: dict[str, "Encoder"] = CACHES.setdefault("tokens", {})


def vocabulary() -> str:
    """The file of the public byte-level vocabulary that the environment offers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _printing(first: np.ndarray, before: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Whether the character that starts with ``first``, and that which ends with ``before[0]``, certainly is no white space.

    ``before``: the bytes backwards. Characters whose lead bytes could stand for white space count as such.
    """
    starts = (first > 32) & (first < 127) | (first >= 0xC3) & (first != 0xE1) & (first != 0xE2) & (first != 0xE3)
    b1, b2, b3, b4 = before
    three = (b2 >= 0x80) & (b2 < 0xC0) & ((b3 == 0xE0) | (b3 >= 0xE4) & (b3 < 0xF0) | (b3 >= 0x80) & (b3 < 0xC0) & (b4 >= 0xF0))
    return starts, (b1 > 32) & (b1 < 127) | (b1 >= 0x80) & ((b2 >= 0xC3) & (b2 < 0xE0) | three)


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin: at each text, before each space and around each newline that stands alone between two
    printing characters, and at a stop or comma after an ASCII letter."""
    begin = np.zeros(len(data) + 1, bool)
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[(at > 0) & (at < len(data) - 1)]
    after, before = _printing(data[at + 1], tuple(data[np.maximum(at - k, 0)] for k in (1, 2, 3, 4)))
    at = at[after & before]
    begin[at] = True
    begin[at[data[at] == 10] + 1] = True
    at = np.flatnonzero((data == 44) | (data == 46))
    at = at[at > 0]
    begin[at[np.isin(data[at - 1] | 32, np.arange(97, 123, dtype=np.uint8))]] = True
    begin[offsets] = True  # empty texts share a place
    return np.flatnonzero(begin)


class Encoder:
    """Whole texts to ids with the tokenizers library.

    A byte-level vocabulary splits texts at lone white space, and between a letter and a stop, before it merges
    anything, so a text is the chain of its pieces, and each distinct piece that is remembered goes through the
    library once. Tests compare with encoding whole texts.
    """

    def __init__(self, path: str, most: int = PIECES) -> None:
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), most
        self.opens = np.zeros(self.library.get_vocab_size(), bool)  # ids whose bytes start with a space
        for token, i in self.library.get_vocab().items():
            self.opens[i] = token.startswith("Ġ")
        self.number: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.uint32)  # of all pieces by number, one after another
        self.size, self.seen = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _keep(self, pieces: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        n = len(self.number)
        self.number.update(zip(pieces, range(n, n + len(pieces))))
        self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size])
        self.seen = np.concatenate([self.seen, np.zeros(len(pieces), np.int64)])

    def _forget(self) -> None:
        """Keeps two thirds of the remembered pieces, those that were seen in most steps."""
        stay = np.sort(np.argsort(-self.seen, kind="stable")[: self.most * 2 // 3])
        names = list(self.number)  # in order of their numbers
        first = np.cumsum(self.size) - self.size
        size = self.size[stay]
        ids = self.ids[np.repeat(first[stay] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        seen = self.seen[stay]
        self.number, self.ids, self.size, self.seen = {names[i]: k for k, i in enumerate(stay.tolist())}, ids, size, seen

    def _learn(self, pieces: list[bytes]) -> None:
        """Pieces with a space before them go through the library many in one text, which comes apart where ids start with a space."""
        spaced = [p for p in pieces if p[0] == 32 and b" " not in p[1:]]
        groups = [spaced[i : i + 64] for i in range(0, len(spaced), 64)]
        done, ids, sizes, rest = [], [], [], [p for p in pieces if p[0] != 32 or b" " in p[1:]]
        for some, got in zip(groups, self.library.encode_batch_fast([b"".join(g).decode() for g in groups], add_special_tokens=False)):
            own = np.array(got.ids, np.uint32)
            at = np.flatnonzero(self.opens[own])
            if len(at) == len(some) and not at[0]:
                done += some
                ids.append(own)
                sizes.append(np.diff(at, append=len(own)))
            else:
                rest += some
        for got in self.library.encode_batch_fast([p.decode() for p in rest], add_special_tokens=False):
            ids.append(np.array(got.ids, np.uint32))
        sizes += [np.array([len(x) for x in ids[len(sizes) :]], np.int64)]
        self._keep(done + rest, np.concatenate([*ids, np.zeros(0, np.uint32)]), np.concatenate(sizes))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has. ``texts`` has no nulls and 32-bit offsets."""
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1]
        if not n or offsets[0] == offsets[-1]:
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        begin = _cuts(data, offsets)  # ends with len(data)
        pieces = pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer(begin.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        names, at = pieces.dictionary.to_numpy(zero_copy_only=False), pieces.indices.to_numpy()
        if len(self.number) > self.most:
            self._forget()
        number = np.array(list(map(self.number.get, names, repeat(-1))), np.int64)
        new = number < 0
        if new.any():
            learnt = names[new].tolist()
            self._learn(learnt)
            number[new] = list(map(self.number.__getitem__, learnt))
        self.seen[number] += 1
        size = self.size[number]
        first = (np.cumsum(self.size) - self.size)[number]
        size, first, end = size[at], first[at], np.zeros(len(at) + 1, np.int64)
        np.cumsum(size, out=end[1:])
        ids = self.ids[np.repeat(first - end[:-1], size) + np.arange(end[-1])]
        return ids, np.diff(end[np.searchsorted(begin, offsets)])


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def write_tokens(documents: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, tokenizer: str | None = None, group: int = GROUP) -> None:
    """Write the ids of all texts, ``end_id`` after each document, in ascending order of id (null ids first, ties by text).

    Null texts are empty; repeated rows are written as often as they come; other columns are ignored. A text of any
    length is encoded whole, by itself where it is longer than ``STEP``, and a group ends after it. An empty table gives
    no group. One range shuffle of the texts; tokenising, coding and writing follow in the same tasks.
    """
    ship(documents.sparkSession)
    name = tokenizer or vocabulary()
    docs = documents.select(col(doc_id).alias("doc_id"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    docs = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    kind = docs.schema["doc_id"].dataType
    fields = f"shard int, number int, n_tokens bigint, doc_ids array<{kind.simpleString()}>, lengths array<bigint>, table binary, blocks array<binary>"

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        settle("tokens")
        own = encoder(name)
        shard, number = TaskContext.get().partitionId(), 0
        ids, lengths, body, total = [], [], [], 0
        schema = pa.schema([("shard", pa.int32()), ("number", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(to_arrow_type(kind))), ("lengths", pa.list_(pa.int64())), ("table", pa.binary()), ("blocks", pa.list_(pa.binary()))])

        def packed():
            whole = np.concatenate(body)
            table = rans.Table.of(whole)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([shard, number, len(whole), ids, lengths, table.to_bytes(), rans.encode(whole, table)], schema.types)], schema=schema)

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            for a, b in steps(pc.binary_length(texts).to_numpy(), STEP):
                got, sizes = own(texts.slice(a, b - a))
                ends = np.cumsum(sizes)
                got = np.insert(got, ends, end_id)  # after each document
                ends += np.arange(1, len(ends) + 1)
                done = 0  # documents of this step that are in a group
                while done < b - a:
                    before = int(ends[done - 1]) if done else 0
                    stop = min(b - a, int(np.searchsorted(ends, before + group - total)) + 1)
                    ids += names[a + done : a + stop]
                    lengths += (sizes[done:stop] + 1).tolist()
                    body.append(got[before : ends[stop - 1]])
                    total += int(ends[stop - 1]) - before
                    done = stop
                    if total >= group:
                        yield packed()
                        number, ids, lengths, body, total = number + 1, [], [], [], 0
        if ids:
            yield packed()

    docs.mapInArrow(run, fields).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, *, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and the ids (little-endian, 32 bits each; null without ``with_ids``) of
    every document in the files. A bad checksum fails the read."""
    ship(spark)
    groups = spark.read.parquet(path)
    kind = groups.schema["doc_ids"].dataType.elementType.simpleString()
    sums = groups.select("shard", "number", "n_tokens")
    shards = sums.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before(Window.orderBy("shard"))), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("shard").orderBy("number"))), F.lit(0))
    starts = sums.select("shard", "number", inside.alias("inside")).join(shards, "shard").select("shard", "number", (F.col("base") + F.col("inside")).alias("start"))

    def run(batches):
        settle()
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                ids = rans.decode(r["blocks"], rans.Table.from_bytes(r["table"])).astype("<u4")
                ends = np.cumsum(r["lengths"])
                begins = ends - np.array(r["lengths"])
                for a, b in steps(r["lengths"], 1 << 18):
                    raw = [ids[i:j].tobytes() for i, j in zip(begins[a:b], ends[a:b])]
                    n = b - a
                    yield pa.RecordBatch.from_arrays([pa.array([r["shard"]] * n, pa.int32()), pa.array([r["number"]] * n, pa.int32()), pa.array(r["doc_ids"][a:b], batch.schema.field("doc_ids").type.value_type), pa.array(begins[a:b]), pa.array(r["lengths"][a:b], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(raw if with_ids else [None] * n, pa.binary())], names=["shard", "number", "doc_id", "at", "n_tokens", "ids_crc32", "ids"])

    docs = groups.select("shard", "number", "doc_ids", "lengths", "table", "blocks").mapInArrow(run, f"shard int, number int, doc_id {kind}, at bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
    return docs.join(starts, ["shard", "number"]).select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")


def token_output(documents: DataFrame, *, path: str | None = None, with_ids: bool = True, **options) -> DataFrame:
    """Writes the files (to ``path``, or a new folder of the shared one) and reads them back."""
    spark = documents.sparkSession
    path = path or new_path(spark, "tokens")
    write_tokens(documents, path, **options)
    return read_tokens(spark, path, with_ids=with_ids)
