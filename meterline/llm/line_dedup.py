"""Line dedup (operator 6): levelled sorted runs of line hashes.

A run is a table ``key`` bucketed and sorted by key: the line keys first seen by some batch. A new batch keeps its own
keys that no run holds (one merge anti-join a run), and they become a new run of level 0. When a level has as many runs
as the fan-out, they are merged into one run of the next level, so a store of n batches has O(log n) runs. All runs
have the same buckets, so neither an anti-join nor a merge shuffles a run again.
Batches go in ascending order of id, so a key that a run holds was first seen in a document of smaller id.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import new_path
from .tables import col, discard, materialize, steps, texts_of

_STRIP = b" \t\n\v\f\r"


def line_key(line: bytes, least: int) -> bytes | None:
    """16 bytes that stand for the line stripped and with A-Z lowered; None under ``least`` code points."""
    line = line.strip(_STRIP).lower()  # of bytes, lower() changes A-Z only
    if len(line) < least or len(line) < 4 * least and sum(b & 0xC0 != 0x80 for b in line) < least:
        return None
    return hashlib.blake2b(line, digest_size=16).digest()


class Run:
    """A bucketed table in the shared folder, known to the session's catalog until it is dropped."""

    def __init__(self, rows: DataFrame, buckets: int) -> None:
        self.schema = rows.schema
        self.spark, self.name, self.path = rows.sparkSession, f"meterline_run_{uuid.uuid4().hex}", new_path(rows.sparkSession, "run")
        rows.write.format("parquet").bucketBy(buckets, "key").sortBy("key").option("path", self.path).saveAsTable(self.name)

    def keys(self) -> DataFrame:
        return self.spark.table(self.name).select("key")

    def rows(self) -> DataFrame:
        """The same files without their buckets, for joins in which a hot key must be split."""
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        files = self.rows()
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        discard(files)


class LineRuns:
    """The levelled runs. ``add`` takes batches in ascending order of id; ``close`` drops the runs."""

    def __init__(self, spark: SparkSession, fan_out: int = 2) -> None:
        self.fan_out = fan_out
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[Run]] = []

    def runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """``lines(doc_id, key)`` of a batch → those ``(doc_id, key)`` that another document of smaller id holds."""
        fresh = lines.groupBy("key").agg(F.min("doc_id").alias("first"))
        for run in self.runs():
            fresh = fresh.join(run.keys().hint("merge"), "key", "left_anti")
        fresh = Run(fresh.repartition(self.buckets, "key"), self.buckets)
        dropped = lines.join(fresh.rows().withColumnRenamed("first", "owner"), "key", "left").where(F.col("owner").isNull() | (F.col("owner") < F.col("doc_id"))).select("doc_id", "key")
        dropped = materialize(dropped, "dropped")
        self._push(fresh, 0)
        return dropped

    def _push(self, run: Run, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan_out:
            old, self.levels[level] = self.levels[level], []
            merged = old[0].keys()
            for r in old[1:]:  # no key is in two runs: bucket by bucket, all keys of both
                merged = merged.join(r.keys().hint("merge"), "key", "full_outer").select("key")
            new = Run(merged, self.buckets)
            for r in old:
                r.drop()
            self._push(new, level + 1)

    def close(self) -> None:
        for r in self.runs():
            r.drop()
        self.levels = []


def _lines(documents: DataFrame, least: int) -> DataFrame:
    """``doc_id, key``: the distinct line keys of each document."""

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(1)).cast(pa.binary())
            at, keys = [], []
            for i, t in enumerate(texts):
                own = {k for line in t.as_py().split(b"\n") if (k := line_key(line, least))}
                keys += own
                at += [i] * len(own)
                if len(keys) > 100_000:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(keys, pa.binary())], names=["doc_id", "key"])
                    at, keys = [], []
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(keys, pa.binary())], names=["doc_id", "key"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.where("doc_id is not null and text is not null").mapInArrow(run, f"doc_id {kind}, key binary")


def dedup_lines(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", batches: int = 4, fan_out: int = 2, least: int = 10) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped`` of every document, the text without its dropped lines.

    Texts split at newlines (null or empty: one empty line). Lines of equal key (white space stripped, A-Z lowered,
    ``least`` code points at least) in two or more documents stay only in the document of smallest id, there every
    time they occur. Rows of one id are one document. Rows without id keep all lines and hold none against others.
    ``doc_id`` is numeric; documents are taken in ``batches`` ranges of it. Other columns are ignored.
    """
    ship(documents.sparkSession)
    docs = documents.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text"))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)] or [1.0], 10_000)).first()[0] or []
    bounds = sorted(set(bounds)) if batches > 1 else []
    number = sum((F.when(F.col("doc_id") > b, 1).otherwise(0) for b in bounds), F.lit(0))
    lines = materialize(_lines(docs, least).withColumn("batch", number), "lines", "batch")
    store, dropped = LineRuns(documents.sparkSession, fan_out), None
    for b in range(len(bounds) + 1):
        part = store.add(lines.where(F.col("batch") == b).select("doc_id", "key"))
        dropped = part if dropped is None else dropped.unionByName(part)
    store.close()
    dropped = dropped.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    joined = docs.join(dropped, "doc_id", "left")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(rows):
        for batch in rows:
            texts = texts_of(batch.column(1))
            sizes = [len(t) for t in texts.cast(pa.binary()).to_pylist()] if len(texts) else []
            for a, b in steps(sizes, 8 << 20):
                n_lines, n_dropped, kept = [], [], []
                for t, keys in zip(texts.slice(a, b - a).cast(pa.binary()), batch.column(2).slice(a, b - a)):
                    body = t.as_py()
                    if not keys.is_valid:
                        n_lines.append(body.count(b"\n") + 1)
                        n_dropped.append(0)
                        kept.append(body)
                        continue
                    gone, whole = set(keys.as_py()), body.split(b"\n")
                    stay = [x for x in whole if line_key(x, least) not in gone]
                    n_lines.append(len(whole))
                    n_dropped.append(len(whole) - len(stay))
                    kept.append(b"\n".join(stay))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=["doc_id", "text", "n_lines", "n_dropped"])

    return joined.select("doc_id", "text", "keys").mapInArrow(run, f"doc_id {kind}, text string, n_lines bigint, n_dropped bigint")
