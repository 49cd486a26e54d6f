"""A static range asymmetric numeral system over token ids, vectorised over interleaved lanes.

A *group* is one frequency table and the blocks it encodes. A *block* is up to BLOCK ids, dealt row by row over
LANES states that share one stream of 32-bit words. Blocks are independent; inside a block, checkpoints hold the
states and the stream position before every CHECK-th row, and each stretch between them has its own checksum, so
stretches decode independently too.

Block bytes (little-endian): ``RNS1``, u32 ids, u32 rows, u32 words, u32 checkpoints, u32 crc of every stretch,
u32 stream position of every stretch, u64 states of every stretch, u32 words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK, LANES, CHECK = 1 << 16, 256, 128
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_MASK = np.uint64(0xFFFFFFFF)


class Table:
    """Frequencies of the symbols that occur, scaled to a sum of a power of two, at least 1 each."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray) -> None:
        self.symbols, self.freq = symbols.astype(np.uint32), freq.astype(np.uint64)
        self.bits = int(freq.sum()).bit_length() - 1
        self.start = np.cumsum(self.freq) - self.freq

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        n = counts[symbols]
        total = 1 << max(14, int(len(symbols)).bit_length() + 3)
        freq = 1 + (n * ((total - len(symbols)) / n.sum())).astype(np.int64)
        freq[int(np.argmax(freq))] += total - int(freq.sum())
        return cls(symbols, freq)

    def to_bytes(self) -> bytes:
        return zlib.compress(np.diff(self.symbols, prepend=np.uint32(0)).astype("<u4").tobytes() + self.freq.astype("<u4").tobytes(), 6)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Table:
        both = np.frombuffer(zlib.decompress(raw), "<u4")
        n = len(both) // 2
        return cls(np.cumsum(both[:n], dtype=np.uint32), both[n:])

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.symbols), dtype=np.uint32), self.freq.astype(np.int64))


def encode(ids: np.ndarray, table: Table) -> list[bytes]:
    """The blocks of ``ids``. Blocks advance together, longest first, so that each step works on many lanes."""
    n = len(ids)
    if not n:
        return []
    index = np.zeros(int(table.symbols[-1]) + 1, np.int32)
    index[table.symbols] = np.arange(len(table.symbols))
    symbol = index[ids]
    full = -(-n // BLOCK)
    sizes = [min(BLOCK, n - b * BLOCK) for b in range(full)]
    rows = [-(-s // LANES) for s in sizes]
    padded = np.full(full * BLOCK, int(np.argmax(table.freq)), np.int32)
    padded[:n] = symbol
    grid = padded.reshape(full, BLOCK // LANES, LANES)
    f_all, c_all, top = table.freq, table.start, table.freq << np.uint64(63 - table.bits)
    bits = np.uint64(table.bits)
    x = np.full((full, LANES), _LOW, np.uint64)
    out: list[list[np.ndarray]] = [[] for _ in range(full)]
    marks: list[list[np.ndarray]] = [[] for _ in range(full)]
    for t in range(max(rows) - 1, -1, -1):
        k = full if t < rows[-1] else full - 1  # only the last block can be shorter
        s = grid[:k, t]
        f = f_all[s]
        now = x[:k]
        over = now >= top[s]
        low = (now & _MASK).astype(np.uint32)
        for b in range(k):
            out[b].append(low[b][over[b]])
        now = np.where(over, now >> _WORD, now)
        q = now // f
        x[:k] = (q << bits) + (now - q * f) + c_all[s]
        if t % CHECK == 0:
            for b in range(k):
                marks[b].append(x[b].copy())
    blocks = []
    for b in range(full):
        words = out[b][::-1]
        ends = np.cumsum([len(w) for w in words])
        stops = range(0, rows[b], CHECK)
        positions = [int(ends[t - 1]) if t else 0 for t in stops]
        own = ids[b * BLOCK : b * BLOCK + sizes[b]].astype("<u4")
        crcs = [zlib.crc32(own[t * LANES : (t + CHECK) * LANES].tobytes()) for t in stops]
        stream = np.concatenate(words).astype("<u4")
        blocks.append(b"RNS1" + struct.pack("<4I", sizes[b], rows[b], len(stream), len(crcs)) + struct.pack(f"<{len(crcs)}I", *crcs) + struct.pack(f"<{len(crcs)}I", *positions) + b"".join(m.astype("<u8").tobytes() for m in marks[b][::-1]) + stream.tobytes())
    return blocks


def decode(blocks: list[bytes], table: Table) -> np.ndarray:
    """All ids of the blocks, every stretch checked; all stretches advance together, each from its own checkpoint."""
    if not blocks:
        return np.zeros(0, np.uint32)
    states, streams, begins, heights, sizes, crcs = [], [], [], [], [], []
    base = 0
    for raw in blocks:
        if raw[:4] != b"RNS1":
            raise ValueError("not a block")
        n, rows, words, marks = struct.unpack_from("<4I", raw, 4)
        at = 20
        crcs += struct.unpack_from(f"<{marks}I", raw, at)
        begins += [base + p for p in struct.unpack_from(f"<{marks}I", raw, at + 4 * marks)]
        at += 8 * marks
        states.append(np.frombuffer(raw, "<u8", marks * LANES, at).reshape(marks, LANES))
        at += 8 * marks * LANES
        if len(raw) != at + 4 * words:
            raise ValueError("a block is cut short")
        streams.append(np.frombuffer(raw, "<u4", words, at))
        base += words
        for m in range(marks):
            heights.append(min(CHECK, rows - m * CHECK))
            sizes.append(min(CHECK * LANES, n - m * CHECK * LANES))
    x = np.concatenate(states).astype(np.uint64)
    stream = np.concatenate([*streams, np.zeros(LANES, np.uint32)]).astype(np.uint64)
    heights, at = np.array(heights), np.array(begins)
    order = np.argsort(-heights, kind="stable")
    x, at, heights = x[order], at[order], heights[order]
    slots, freq, start, bits = table.slots(), table.freq, table.start, np.uint64(table.bits)
    mask = np.uint64((1 << table.bits) - 1)
    out = np.zeros((len(heights), CHECK, LANES), np.uint32)
    for t in range(int(heights[0])):
        k = int(np.searchsorted(-heights, -t, "left"))
        now = x[:k]
        slot = now & mask
        s = slots[slot.astype(np.int64)]
        out[:k, t] = s
        now = freq[s] * (now >> bits) + slot - start[s]
        need = now < _LOW
        rank = np.cumsum(need, axis=1)
        take = at[:k, None] + rank - 1
        now = np.where(need, (now << _WORD) | stream[np.where(need, take, 0)], now)
        at[:k] += rank[:, -1]
        x[:k] = now
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    parts = []
    for m, n in enumerate(sizes):
        part = table.symbols[out[back[m]].reshape(-1)[:n]]
        if zlib.crc32(part.astype("<u4").tobytes()) != crcs[m]:
            raise ValueError("a stretch fails its checksum")
        parts.append(part)
    return np.concatenate(parts)
