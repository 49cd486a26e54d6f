"""Words, word hashes and shingle hashes of many texts at once, from their UTF-8 bytes.

Both word patterns in use keep or drop every non-ASCII character alike, so a table of 256
byte classes gives exactly the matches of the pattern on the text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .tables import texts_of

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _classes(word_byte) -> np.ndarray:
    return np.array([word_byte(i) for i in range(256)], dtype=np.uint8)


#: Bytes that are lower-case letters once A-Z is lowered; the rest as they are.
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], dtype=np.uint8)
#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = _classes(lambda i: i != 32 and not 9 <= i <= 13)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lowering A-Z
ALNUM = _classes(lambda i: 48 <= i <= 57 or 97 <= i <= 122 or i >= 128)
#: runs of letters, digits and non-ASCII (1), runs of other printing characters (2)
WORD_OR_MARK = _classes(lambda i: 1 if 48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122 or i >= 128 else 0 if i == 32 or 9 <= i <= 13 else 2)


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit over the 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n + n // 4, 5 << 17)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """Words of consecutive texts; ``first[d]:first[d + 1]`` are those of text d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the first words, and hashes, of all runs of k words inside one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h *= np.uint64(0xD6E8FEB86659FD93)
            h += self.hash[j : n + j]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, mix(h[at])


def words_of(texts: pa.Array, classes: np.ndarray, lower: bool = True) -> Words:
    texts = texts_of(texts)
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = LOWER[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, none, np.zeros(n + 1, np.int64), np.zeros(0, np.uint64))
    kind = classes[data]
    change = np.ones(len(data) + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
    change[offsets] = True
    start = np.flatnonzero(change[:-1] & (kind > 0))
    end = np.flatnonzero(change[1:] & (kind > 0)) + 1
    up, down = _power(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(n), np.diff(first))
    return Words(data, start, end, doc, first, h)
