"""Vectorised words, lines and hashes over the UTF-8 bytes of many texts at once.

A chunk is a run of whole texts joined by newlines, a quarter of a MB long, so that
the eight-byte arrays of a worker stay bounded and in its cache whatever the batch size (one text
longer than a chunk is a chunk of its own). Span hashes are differences of a
prefix sum of T[byte] * p**position modulo 2**64, moved to position 0 by the
inverse power and mixed: equal spans have equal hashes wherever they start, and
unequal ones collide with a chance of about 2**-63 a pair."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
SEP = np.zeros(256, bool)
SEP[[0x20, 9, 10, 11, 12, 13]] = True
_TABLE = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_POW: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i for i < n, modulo 2**64."""
    if len(_POW[0]) < n:
        size = max(n, CHUNK + 4096)
        for k, base in enumerate((_P, _PINV)):
            a = np.full(size, base, U64)
            a[0] = 1
            _POW[k] = np.multiply.accumulate(a)
    return _POW[0][:n], _POW[1][:n]


@dataclass
class Chunk:
    rows: slice  # of the batch
    buf: np.ndarray  # the texts' bytes, a newline after each
    start: np.ndarray  # of each text in buf
    stop: np.ndarray

    def prefix(self) -> np.ndarray:
        p, _ = powers(len(self.buf) + 1)
        out = np.zeros(len(self.buf) + 1, U64)
        np.cumsum(_TABLE[self.buf] * p[:-1], out=out[1:])
        return out

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs without 0x20, 0x09-0x0D."""
        sep = SEP[self.buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], sep, [True])).view(np.int8)))
        return edge[::2], edge[1::2]

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all lines of all texts, empty ones too (each text has at least one)."""
        end = np.flatnonzero(self.buf == 10)
        return np.concatenate(([0], end[:-1] + 1)).astype(np.int64), end

    def owner(self, at: np.ndarray) -> np.ndarray:
        """Which text of the chunk each position is in."""
        return np.searchsorted(self.start, at, side="right") - 1


def spans(prefix: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    _, inv = powers(len(prefix))
    return mix((prefix[e] - prefix[s]) * inv[s] + (e - s).astype(U64))


def sums(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Sum of values[start:stop] for each pair."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[stop] - c[start]


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK, rows: int = 256) -> Iterator[Chunk]:
    """Whole texts of a string column in chunks of about limit bytes; a null is an empty text. `rows` bounds what is copied at once."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for first in range(0, len(column), rows):
        part = column.slice(first, rows).cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)
        i, n = 0, len(part)
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
            length = np.diff(offsets[i : j + 1])
            stop = np.cumsum(length + 1) - 1
            start = stop - length
            buf = np.full(int(stop[-1]) + 1, 10, np.uint8)
            inside = np.ones(len(buf), bool)
            inside[stop] = False
            buf[inside] = data[offsets[i] : offsets[j]]
            yield Chunk(slice(first + i, first + j), buf, start, stop)
            i = j


def word_hashes(c: Chunk, prefix: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's hash and text in the chunk, and the number of words of each text."""
    s, e = c.words()
    h = spans(c.prefix() if prefix is None else prefix, s, e)
    who = c.owner(s)
    return h, who, np.bincount(who, minlength=len(c.start))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k successive entries; len(h) - k + 1 of them (none if fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for i in range(k):
        out = out * U64(0x2545F4914F6CDD1D) + h[i : i + n]
        out ^= out >> U64(29)
    return mix(out)
