"""Array kernels over batches of texts: word hashing, shingles and windows, without a Python step per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators of plain words: every ASCII character but letters and digits.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * U(2) + U(1)
_POWERS: dict[str, np.ndarray] = {}
#: Bytes of text that are worked on at a time; one longer text is a chunk of its own.
CHUNK = 1 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=np.uint64)
        if n > 8 * CHUNK:
            up, down = _POWERS["up"], _POWERS["down"]
            _POWERS.clear()
            return up, down
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few rows: what is made of Python objects at a time stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        release()


def release() -> None:
    """Give back what Arrow's pool holds without need: several workers share an executor's memory."""
    pa.default_memory_pool().release_unused()


def views(column: pa.ChunkedArray | pa.Array, dtype) -> list[np.ndarray]:
    """The values of a binary column as arrays over its own memory."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        return []
    to = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).tolist() if len(column) else [0]
    size = np.dtype(dtype).itemsize
    return [np.frombuffer(column.buffers()[2], dtype, (b - a) // size, a) if b > a else np.zeros(0, dtype) for a, b in zip(to[:-1], to[1:])]


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) over runs of rows of about CHUNK bytes; a null is an empty text."""
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of several texts: ``hash`` a word, ``offsets`` of each text's words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, separators: np.ndarray = _SPACE):
        n = len(data)
        if lower:
            data = _LOWER[data]
        solid = ~separators[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | edge[1:n]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:] | edge[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        up, down = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        self.offsets = np.searchsorted(self.start, offsets)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets by text) of all k-word windows, in order; fewer words than k make one window of all."""
    h, off = words.hash, words.offsets
    counts = np.diff(off)
    out = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    to = np.concatenate(([0], np.cumsum(out)))
    doc = np.repeat(np.arange(len(counts)), out)
    first = off[:-1][doc] + (np.arange(to[-1]) - to[:-1][doc])
    acc = np.zeros(to[-1], np.uint64)
    last = off[1:][doc]
    padded = np.concatenate((h, np.zeros(k, np.uint64)))
    for j in range(k):
        there = first + j < last
        acc = mix(acc * _BASE + np.where(there, padded[first + j] | U(1), U(2 * j)))
    return acc, to


def sets(hashes: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    for a, b in zip(offsets[:-1], offsets[1:]):
        yield np.unique(hashes[a:b])


def set_key(s: np.ndarray) -> bytes:
    """128 bits that depend on the members alone."""
    return np.array([mix(s).sum(dtype=np.uint64), mix(s ^ U(0xD1B54A32D192ED03)).sum(dtype=np.uint64)], np.uint64).tobytes()
