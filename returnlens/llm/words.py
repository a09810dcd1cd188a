"""Words, lines and their 64-bit hashes over whole Arrow string columns, as numpy work on bytes.

A word is a run of bytes outside space and the control characters 9 to 13, a line a run outside the
line feed. Both separators are single bytes, so UTF-8 needs no decoding. A hash is a sum of
``TABLE[byte] * BASE ** position`` modulo 2**64, finalised by two multiply-xor rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
PIECE_BYTES = 1 << 16
_random = np.random.default_rng(20240607)
TABLE = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
IS_FEED = np.zeros(256, dtype=bool)
IS_FEED[10] = True
_powers = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """BASE to the powers 0 to n - 1, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        grown = np.full(size, BASE, dtype=np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column laid end to end and the n + 1 offsets; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


def runs(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of non-separators; a text's end also ends a run."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of data[start:end] of every run, in pieces that stay in the cache."""
    out = np.empty(len(starts), dtype=np.uint64)
    table = TABLE[LOWER] if lower else TABLE
    lengths = ends - starts
    total = np.concatenate([[0], np.cumsum(lengths)])
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(total, total[at] + PIECE_BYTES, side="right")) - 1)
        if to == at + 1 and lengths[at] > PIECE_BYTES:
            out[at] = _long_hash(data[starts[at]:ends[at]], table)
        else:
            span = table[data[starts[at]:ends[to - 1]]]
            size = lengths[at:to]
            begin = np.cumsum(size) - size
            place = np.arange(int(size.sum())) - np.repeat(begin, size)
            inside = np.repeat(starts[at:to] - starts[at], size) + place
            out[at:to] = np.add.reduceat(span[inside] * powers(int(size.max()))[place], begin)
        at = to
    return mix(out ^ (lengths.astype(np.uint64) * MIX_B))


def _long_hash(data: np.ndarray, table: np.ndarray) -> np.uint64:
    total = np.zeros(1, dtype=np.uint64)
    factor = powers(CHUNK_BYTES)
    shift, step = np.ones(1, dtype=np.uint64), factor[-1:] * BASE
    for at in range(0, len(data), CHUNK_BYTES):
        piece = table[data[at:at + CHUNK_BYTES]]
        total += (piece * factor[:len(piece)]).sum(dtype=np.uint64) * shift
        shift = shift * step
    return total[0]


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a string column, and the n + 1 places at which each text's words begin."""
    data, offsets = text_bytes(column)
    starts, ends = runs(data, offsets, IS_SPACE)
    return run_hashes(data, starts, ends, lower), np.searchsorted(starts, offsets)


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES * 4) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of a bounded number of text bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


class HashIndex:
    """Place of a 64-bit key in an array of distinct keys: tables of one slot per hash, each holding
    what did not fit before."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.levels = keys, []
        left, bits = np.arange(len(keys)), max(10, int(len(keys)).bit_length() + 3)
        while len(left):
            slots = (keys[left] >> np.uint64(len(self.levels) * 7 % 40)) & np.uint64((1 << bits) - 1)
            table = np.full(1 << bits, -1, dtype=np.int32)
            table[slots[::-1]] = left[::-1]
            self.levels.append((len(self.levels) * 7 % 40, table))
            left, bits = left[table[slots] != left], max(10, bits - 3)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of every key, -1 where there is none."""
        out = np.full(len(keys), -1, dtype=np.int32)
        rest = np.arange(len(keys))
        for shift, table in self.levels:
            got = table[(keys[rest] >> np.uint64(shift)) & np.uint64(len(table) - 1)]
            hit = (got >= 0) & (self.keys[got] == keys[rest])
            out[rest[hit]] = got[hit]
            rest = rest[~hit & (got >= 0)]
        return out
