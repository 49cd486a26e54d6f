"""Shared tables and row-wise Arrow passes used by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from ..storage import new_path

#: Bytes of text that one step of a row-wise pass handles at once (one longer text is a step of its own).
STEP_BYTES = 1 << 19


#: What workers keep from task to task, by the pass that fills it.
CACHES: dict[str, dict] = {}


try:  # what the C library has freed goes back to the system only when asked
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def settle(name: str = "") -> None:
    """At the start of a task: workers live on, so what other passes kept, and all free memory, is given back."""
    for other, kept in CACHES.items():
        if other != name:
            kept.clear()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def materialize(df: DataFrame, tag: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage in a way that outlives lost executors."""
    path = new_path(df.sparkSession, tag)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folder of a table made by :func:`materialize` that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/meterline-" in f}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def col(name: str):
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def texts_of(column: pa.Array) -> pa.Array:
    """A string column without nulls (null becomes empty), with 32-bit offsets that start at this slice."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(column, "").cast(pa.string())


def steps(lengths, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose lengths sum to at most ``most``, at least one row each."""
    begin, total = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield begin, len(lengths)


def map_texts(df: DataFrame, text: str, keep: Sequence[str], fn: Callable[[pa.Array], dict], fields: str, most: int = STEP_BYTES) -> DataFrame:
    """One result row for each row of ``df``: struct ``row`` of the kept columns, then ``fields`` as ``fn`` makes them.

    ``fn`` gets a string array (null texts as null) of a bounded number of bytes and returns a list for each field.
    The kept columns travel inside a struct, so their names can't clash with those of the results.
    """
    ship(df.sparkSession)
    inside = text in keep
    source = df.select(F.struct(*[col(c) for c in keep]).alias("row"), *([] if inside else [col(text).cast("string").alias("text")]))
    schema = T.StructType([source.schema["row"], *T.StructType.fromDDL(fields)])
    at = list(keep).index(text) if inside else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        settle()
        target = to_arrow_schema(schema)
        for batch in batches:
            rows = batch.column(0)
            whole = rows.field(at).cast(pa.string()) if inside else batch.column(1)
            if inside and rows.offset and len(whole) != len(rows):
                whole = whole.slice(rows.offset, len(rows))
            for a, b in steps(pc.fill_null(pc.binary_length(whole), 0).to_numpy(), most):
                got = fn(whole.slice(a, b - a))
                arrays = [rows.slice(a, b - a)] + [pa.array(got[f.name], type=f.type) if not isinstance(got[f.name], pa.Array) else got[f.name] for f in list(target)[1:]]
                yield pa.RecordBatch.from_arrays(arrays, names=target.names)

    return source.mapInArrow(run, schema)


def by_group(df: DataFrame, keys: Sequence[str], values: Sequence[str], fn: Callable[[list[tuple]], list[tuple]], fields: str) -> DataFrame:
    """Rows that ``fn`` makes from the value tuples of each group of ``keys``, sorted by the first value.

    For very many small groups: groups stream through a task that holds one at a time. Callers bound group sizes.
    """
    ship(df.sparkSession)
    schema = T.StructType.fromDDL(fields)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        settle()
        target = to_arrow_schema(schema)
        key, held, out = None, [], []

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), target.types)], schema=target)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for k, v in zip(zip(*columns[:n]), zip(*columns[n:])):
                if k != key:
                    if held:
                        out += fn(held)
                    key, held = k, []
                    if len(out) > 20_000:
                        yield packed()
                        out = []
                held.append(v)
        if held:
            out += fn(held)
        if out:
            yield packed()

    source = df.select(*keys, *values)
    return source.repartition(*keys).sortWithinPartitions(*keys, values[0]).mapInArrow(run, schema)


def sum_vectors(df: DataFrame, dtype: str) -> DataFrame:
    """``part, v`` summed by part, ``v`` being the bytes of a numpy vector of ``dtype``, one row a part and task.

    Sums of at most 256 tasks first, then the sums of those, so no group grows with the number of tasks as such.
    """
    ship(df.sparkSession)

    def add(table: pa.Table) -> pa.Table:
        rows = iter(table.column("v"))
        total = np.frombuffer(next(rows).as_py(), dtype).copy()
        for x in rows:
            total += np.frombuffer(x.as_py(), dtype)
        return pa.table({"part": table.column("part").slice(0, 1).cast(pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})

    some = df.withColumn("tasks", F.floor(F.spark_partition_id() / 256)).groupBy("part", "tasks").applyInArrow(add, "part int, v binary")
    return some.groupBy("part").applyInArrow(add, "part int, v binary")


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id's text leaves 2 modulo 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2
