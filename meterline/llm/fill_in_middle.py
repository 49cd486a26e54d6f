"""Fill-in-middle transformation (operator 11): documents cut at two line ends and put together in another order.

Plan: one row-wise pass, no shuffle. A rolling hash over the last 32 bytes cuts a text into chunks whose borders depend
on content alone, so passages that documents share become the same chunks. A worker keeps a summary of each chunk
(line ends, code points) under its checksum; a chunk found again is compared byte by byte before its summary is used.
Summaries are added from left to right: the sums give the number of lines, and the two chunks in which the cuts fall;
only these two are searched for the line end itself.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .tables import CACHES, col, settle, steps, texts_of

#: Bytes that the rolling hash sees, and of a chunk: least, most, and on average beyond the least.
WINDOW, LEAST, MOST, MEAN = 32, 256, 8192, 2048
#: Bytes of chunks that a worker remembers at most; the oldest go first. Only speed depends on it.
MEMO_BYTES = 16 << 20

_GEAR = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte, a hash of it and the 31 before it: each weighs twice the next older one, modulo 2**64."""
    h, reach = _GEAR[data], 1
    while reach < WINDOW:
        h[reach:] += h[:-reach] << np.uint64(reach)
        reach *= 2
    return h


def chunk_ends(hashes: np.ndarray) -> list[int]:
    """Ends of the chunks of one text, from its rolling hashes: where 11 high bits are zero, but LEAST to MOST bytes."""
    n, ends, last = len(hashes), [], 0
    for c in [*(np.flatnonzero(hashes[WINDOW - 1 :] >> np.uint64(64 - MEAN.bit_length() + 1) == 0) + WINDOW).tolist(), n]:
        if c < n and c - last < LEAST:
            continue
        while c - last > MOST:
            last += MOST
            ends.append(last)
        if c > last:
            ends.append(c)
            last = c
    return ends


class Memo:
    """Summaries (line ends, code points) of chunks, of at most ``most`` bytes of content."""

    def __init__(self, most: int = MEMO_BYTES):
        self.most, self.held, self.known, self.reused = most, 0, {}, 0

    def summary(self, chunk: bytes) -> tuple[int, int]:
        key = zlib.crc32(chunk), len(chunk)
        if (found := self.known.get(key)) and found[0] == chunk:
            self.reused += 1
            return found[1]
        raw = np.frombuffer(chunk, np.uint8)
        out = chunk.count(b"\n"), int(np.count_nonzero((raw & 0xC0) != 0x80))
        if not found:
            self.known[key] = chunk, out
            self.held += len(chunk)
            while self.held > self.most:
                self.held -= len(self.known.pop(next(iter(self.known)))[0])
        return out


class Lines:
    """The lines of one text, known by the summaries of its chunks."""

    def __init__(self, text: bytes, ends: Sequence[int], memo: Memo):
        self.text, self.ends = text, [0, *ends]
        sums = [memo.summary(text[a:b]) for a, b in zip(self.ends, ends)]
        self.breaks = np.cumsum([0, *(s[0] for s in sums)])
        self.chars = np.cumsum([0, *(s[1] for s in sums)])
        self.n = int(self.breaks[-1]) + (bool(text) and not text.endswith(b"\n"))

    def end_of(self, k: int) -> tuple[int, int]:
        """Bytes and code points of the first ``k`` lines."""
        if k == 0:
            return 0, 0
        if k == self.n:
            return len(self.text), int(self.chars[-1])
        j = int(np.searchsorted(self.breaks, k)) - 1  # the chunk that holds the k-th line end
        chunk = np.frombuffer(self.text, np.uint8)[self.ends[j] : self.ends[j + 1]]
        at = int(np.flatnonzero(chunk == 10)[k - self.breaks[j] - 1]) + 1
        return self.ends[j] + at, int(self.chars[j]) + int(np.count_nonzero((chunk[:at] & 0xC0) != 0x80))


def fill_in_middle(documents: DataFrame, keep: Sequence[str], *, doc_id: str = "doc_id", text: str = "text", seed: int = 7, percent: int = 100, spm_percent: int = 50, sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> DataFrame:
    """Struct ``row`` of the columns to keep, then ``n, form, prefix_chars, middle_chars, output`` of each document.

    ``n`` lines, each with its line end. Draws come from the sha256 of ``seed:doc_id``: two cuts after 0 to n lines, the
    form (``plain`` for all but ``percent`` of the documents), and its order: ``psm`` or, in ``spm_percent``, ``spm``.
    Empty texts and texts that hold a sentinel are plain: their output is the text, their numbers of characters null.
    A null text is the empty one, a null id the empty id; rows of one id are cut by the same draws. :func:`restored`
    takes an output back to its text.
    """
    ship(documents.sparkSession)
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(col(doc_id).cast("string"), F.lit(""))), 256)
    draws = F.transform(F.array(*[F.lit(1 + 8 * i) for i in range(4)]), lambda at: F.conv(F.substring(hexed, at, F.lit(8)), 16, 10).cast("bigint"))
    source = documents.select(F.struct(*[col(c) for c in keep]).alias("row"), col(text).cast("string").alias("text"), draws.alias("draws"))
    schema = T.StructType([source.schema["row"], *T.StructType.fromDDL("n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")])
    p_, s_, m_ = marks = [s.encode() for s in sentinels]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        settle("fim")
        target = to_arrow_schema(schema)
        memo = CACHES.setdefault("fim", {}).setdefault("memo", Memo())
        for batch in batches:
            texts, drawn = texts_of(batch.column(1)), batch.column(2).to_pylist()
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else []
            for a, b in steps(sizes):
                out = []
                for body, (h1, h2, h3, h4) in zip(texts.slice(a, b - a).cast(pa.binary()).to_pylist(), drawn[a:b]):
                    lines = Lines(body, chunk_ends(rolling(np.frombuffer(body, np.uint8))), memo)
                    if not body or any(s in body for s in marks) or h3 % 100 >= percent:
                        out.append((lines.n, "plain", None, None, body))
                        continue
                    cuts = h1 % (lines.n + 1), h2 % (lines.n + 1)
                    (one, chars), (two, upto) = lines.end_of(min(cuts)), lines.end_of(max(cuts))
                    prefix, middle, suffix = body[:one], body[one:two], body[two:]
                    spm = h4 % 100 < spm_percent
                    whole = b"".join((s_, suffix, p_, prefix, m_, middle) if spm else (p_, prefix, s_, suffix, m_, middle))
                    out.append((lines.n, "spm" if spm else "psm", chars, upto - chars, whole))
                columns = list(zip(*out))
                arrays = [pa.array(c, t) for c, t in zip(columns[:4], target.types[1:5])] + [pa.array(columns[4], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *arrays], names=target.names)

    return source.mapInArrow(run, schema)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text from which :func:`fill_in_middle` made this output of this form."""
    parts = F.split(output, "|".join(re.escape(s) for s in sentinels))
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
