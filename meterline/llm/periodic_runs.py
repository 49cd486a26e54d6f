"""Periodic run detection (operator 13): stretches of a document that repeat a word sequence over and over.

Plan: one row-wise pass, no shuffle; a step handles many short documents, or one long one, in whole-array operations.
Words become numbers that differ between documents, so nothing found ever reaches over a document's border.

* Prefix doubling gives the suffix array; its ranks by 1, 2, 4, ... words are kept and answer all later questions
  "how far do these two places agree", to the right and to the left.
* An LCP interval is a range of the suffix array whose suffixes share exactly ``depth`` words; its children are the
  ranges between the borders of that depth. No tree is built: intervals are two searches for the next smaller value.
* For each suffix i of all children but the largest, i + depth and i - depth are looked up in the inverse suffix array.
  If they lie in the interval, two equal sequences of ``depth`` words stand side by side, and where the following word
  differs, this square branches: it is the right end of a run.
* The square is rotated to the left as far as words agree, which gives the whole run. Of equal stretches the smallest
  period is kept.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytewords import NOT_SPACE, Words, words_of
from .tables import map_texts


def ranks_by_length(first: np.ndarray) -> list[np.ndarray]:
    """Ranks of all places by their first 1, 2, 4, ... symbols, until all differ; ``first`` numbers the symbols.

    The rank of a place is the number of places before its group, so places that stand alone are not sorted again.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    new = np.ones(n, bool)
    new[1:] = first[order[1:]] != first[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, reach = [rank.astype(np.int32)], 1
    open_ = np.sort(order[~(new & np.append(new[1:], True))])
    while len(open_):
        after = np.full(len(open_), -1, np.int64)
        inside = open_ + reach < n
        after[inside] = rank[open_[inside] + reach]
        key = rank[open_] * (n + 1) + after + 1
        by = np.argsort(key)
        key, places = key[by], open_[by]
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        group = np.ones(len(key), bool)
        group[1:] = key[1:] // (n + 1) != key[:-1] // (n + 1)
        at = np.arange(len(key))
        within = np.maximum.accumulate(np.where(head, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        rank = rank.copy()
        rank[places] += within
        levels.append(rank.astype(np.int32))
        reach *= 2
        open_ = np.sort(places[~(head & np.append(head[1:], True))])
    return levels


def agreement(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, step: int = 1) -> np.ndarray:
    """How many symbols from different places a and b agree: to the right, or those before them (``step`` -1)."""
    n, out = len(levels[0]), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        size = 1 << k
        x, y = (a + out, b + out) if step > 0 else (a - out - size, b - out - size)
        fits = (x >= 0) & (y >= 0) & (x < n) & (y < n)
        same = np.zeros(len(a), bool)
        same[fits] = levels[k][x[fits]] == levels[k][y[fits]]
        out += np.where(same, size, 0)
    return out


def lcp_intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The borders (places in ``lcp`` above 0) and, of each, the first and the last leaf of its interval."""
    at = np.flatnonzero(lcp > 0)
    if not len(at):
        return at, at, at
    gaps = np.diff(np.flatnonzero(np.concatenate(([True], lcp == 0, [True]))))
    table = [lcp.astype(np.int32)]
    while 1 << len(table) <= gaps.max():
        low, half = table[-1], 1 << (len(table) - 1)
        table.append(np.minimum(low[:-half], low[half:]))
    left, right, own = at.copy(), at.copy(), lcp[at]
    for k in range(len(table) - 1, -1, -1):
        size, least = 1 << k, table[k]
        fits = right + size <= len(lcp)
        fits[fits] = least[right[fits]] >= own[fits]
        right[fits] += size
        fits = left >= size
        fits[fits] = least[left[fits] - size] >= own[fits]
        left[fits] -= size
    return at, left, right


def branching_squares(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Start and half length of every square whose next symbol breaks the period."""
    symbol, isa = levels[0], levels[-1].astype(np.int64)
    n = len(isa)
    sa = np.empty(n, np.int64)
    sa[isa] = np.arange(n)
    lcp = agreement(levels, sa[:-1], sa[1:])
    at, first, last = lcp_intervals(lcp)
    if not len(at):
        return at, at
    by = np.lexsort((at, last, first))
    at, first, last = at[by], first[by], last[by]
    opens = np.ones(len(at), bool)
    opens[1:] = (first[1:] != first[:-1]) | (last[1:] != last[:-1])
    interval = np.cumsum(opens) - 1
    closes = np.append(opens[1:], True)
    # children: what is left of each interval's first border, and what is right of each border up to the next one
    begin = np.concatenate((first[opens], at + 1))
    end = np.concatenate((at[opens], np.where(closes, last, np.append(at[1:], 0))))
    of = np.concatenate((interval[opens], interval))
    size = end - begin + 1
    by = np.lexsort((begin, -size, of))
    small = np.ones(len(by), bool)
    small[0] = False
    small[1:] = of[by[1:]] == of[by[:-1]]  # all but the largest of each interval
    use = by[small]
    depth, low, high = lcp[at[opens]][of[use]], first[opens][of[use]], last[opens][of[use]]
    size, begin = size[use], begin[use]
    leaf = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
    i, depth, low, high = sa[leaf], np.repeat(depth, size), np.repeat(low, size), np.repeat(high, size)

    def differs(a, b):
        """Of places a < b: their symbols differ, or b is past the end."""
        out = b >= n
        out[~out] = symbol[a[~out]] != symbol[b[~out]]
        return out

    found = []
    for start in (i, i - depth):  # i is the left half, or the right one
        other = i + depth if start is i else start
        fits = (other >= 0) & (other < n)
        fits[fits] = (isa[other[fits]] >= low[fits]) & (isa[other[fits]] <= high[fits])
        start, half = start[fits], depth[fits]
        branches = differs(start + half, start + 2 * half)
        found.append(np.stack((start[branches], half[branches])))
    start, half = np.unique(np.concatenate(found, axis=1), axis=1)
    return start, half


def runs(first: np.ndarray, min_exponent: int = 2, min_length: int = 2) -> np.ndarray:
    """``start, length, period`` of every run of a symbol sequence, a row each, by start, then period.

    A run is a stretch with smallest period q that no neighbour extends with that period, of at least ``min_length``
    symbols and ``min_exponent`` (2 or more) periods.
    """
    if len(first) < 2:
        return np.zeros((0, 3), np.int64)
    levels = ranks_by_length(first)
    start, half = branching_squares(levels)
    more = agreement(levels, start, start + half, step=-1)
    begin, length = start - more, 2 * half + more
    enough = length >= np.maximum(min_length, min_exponent * half)
    begin, length, half = begin[enough], length[enough], half[enough]
    by = np.lexsort((half, length, begin))
    begin, length, half = begin[by], length[by], half[by]
    new = np.ones(len(by), bool)
    new[1:] = (begin[1:] != begin[:-1]) | (length[1:] != length[:-1])
    out = np.stack((begin[new], length[new], half[new]), axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _symbols(w: Words) -> np.ndarray:
    """A number for each word: equal for equal words of one document, larger in later documents."""
    known, word = np.unique(w.hash, return_inverse=True)
    return w.doc.astype(np.int64) * max(len(known), 1) + word


def _joined(w: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each text with one space between them."""
    start, end, doc = w.start[kept], w.end[kept], w.doc[kept]
    size = end - start + 1  # and a space
    upto = np.cumsum(size)
    take = np.repeat(start - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)
    out = np.append(w.data, np.uint8(32))[take]
    out[upto - 1] = 32
    last = np.ones(len(doc), bool)
    last[:-1] = doc[1:] != doc[:-1]
    out = np.delete(out, upto[last] - 1)
    sizes = np.bincount(doc, weights=size - last, minlength=len(w.first) - 1).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


def find_runs(documents: DataFrame, keep: Sequence[str], *, text: str = "text", min_exponent: int = 4, min_length: int = 6) -> DataFrame:
    """Struct ``row`` of the columns to keep, then ``n_words, runs, collapsed`` of each document.

    Words are what white space separates, compared by 64-bit hashes. ``runs``: start (word number), length and smallest
    period of every maximal stretch of at least ``min_exponent`` periods and ``min_length`` words, by start, then
    period. ``collapsed``: the words that no run holds after its first period, joined by one space. A null or empty
    text has no words, no runs and the empty collapsed text; equal rows give equal results.
    """

    def detect(texts: pa.Array) -> dict:
        w = words_of(texts, NOT_SPACE, lower=False)
        found = runs(_symbols(w), min_exponent, min_length)
        change = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(change, found[:, 0] + found[:, 2], 1)
        np.add.at(change, found[:, 0] + found[:, 1], -1)
        kept = np.cumsum(change[:-1]) == 0
        lists = [[] for _ in range(len(texts))]
        for d, (start, length, period) in zip(w.doc[found[:, 0]].tolist(), found.tolist()):
            lists[d].append({"start": start - int(w.first[d]), "length": length, "period": period})
        return {"n_words": np.diff(w.first), "runs": lists, "collapsed": _joined(w, kept)}

    return map_texts(documents, text, keep, detect, "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
